"""Estimators and the rule that picks one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions.rows import is_missing
from trellium.operators.baselines import MajorityClassifier, MeanRegressor
from trellium.functions.feature_lists import SchemaError
from trellium.operators.features import Preparation, stages
from trellium.sources.folders import ensure_checkpoint_dir

@dataclass(frozen=True)
class TreeParams:
    """The boosting settings results are compared under."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    seed: int = 42
    parallelism: int = 4  # labels fitted side by side when there are more than two
    most_labels: int | None = None  # more labels than this are an error; they are fitted one by one
    solver: str = "normal"  # of least squares; "l-bfgs" where a matrix of features x features is too large

    def settings(self) -> dict:
        return {
            "maxIter": self.trees,
            "maxDepth": self.depth,
            "stepSize": self.rate,
            "seed": self.seed,
            "checkpointInterval": 10,
            "maxMemoryInMB": 512,
        }


@dataclass
class Fitted:
    model: PipelineModel
    estimator: str
    features: list[str] = field(default_factory=list)
    reason: str | None = None  # why it isn't the estimator that was asked for


def boosted_regressor(target: str, params: TreeParams = TreeParams()) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=target, lossType="squared", **params.settings())


def boosted_classifier(target: str, kind: str, labels: Sequence[str], params: TreeParams = TreeParams()) -> list:
    """Stages from label to predicted label, of the label's own type.

    Two labels fit one model; more fit one model per label against the rest.
    """
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label__code",
        predictionCol="prediction__code",
        **params.settings(),
    )
    index = StringIndexer(inputCol=target, outputCol="label__code", stringOrderType="alphabetAsc")
    if len(labels) > 2:
        trees = OneVsRest(
            classifier=trees,
            featuresCol="features",
            labelCol="label__code",
            predictionCol="prediction__code",
            parallelism=params.parallelism,
        )
    names = IndexToString(inputCol="prediction__code", outputCol="prediction__text", labels=list(labels))
    back = SQLTransformer(
        statement=f"SELECT *, CAST(prediction__text AS {kind}) AS prediction FROM __THIS__"
    )
    return [index, trees, names, back]


def linear_regression(target: str, solver: str = "normal") -> LinearRegression:
    """Ordinary least squares: one aggregation pass by the normal equations (4096 features at most), or iteratively."""
    return LinearRegression(featuresCol="features", labelCol=target, solver=solver, regParam=0.0)


@dataclass(frozen=True)
class Facts:
    """What one aggregate tells before a fit: rows, whether the label varies, and rows without a value per feature."""

    n: int
    varies: bool
    missing: Mapping[str, int] = field(default_factory=dict)


def label_facts(train: DataFrame, target: str, features: Sequence[str] = ()) -> Facts:
    y = F.col(f"`{target}`")
    counts = [F.count_if(is_missing(train, c)).alias(f"m{i}") for i, c in enumerate(features)]
    row = train.agg(F.count("*").alias("n"), (F.min(y) < F.max(y)).alias("varies"), *counts).first()
    return Facts(row.n, bool(row.varies), {c: row[f"m{i}"] for i, c in enumerate(features)})


def fit(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    task: str,
    estimator: str = "boosted",
    params: TreeParams = TreeParams(),
    prep: Preparation = Preparation(),
    facts: Facts | None = None,
) -> Fitted:
    """Fit the wanted estimator, or the constant when the labels leave nothing to learn.

    ``estimator``: ``boosted``, ``linear`` (regression only) or ``constant``.
    Fewer than two rows, or one label only, gives the constant. Singular normal
    equations are solved iteratively by Spark. Features that the preparation
    can't take, missing values among them, are errors that name the columns;
    other errors are raised as they are. ``facts`` spares the pass that finds them.
    """
    facts = facts or label_facts(train, target, features)
    if estimator == "constant" or (why := _nothing_to_learn(facts, estimator, task)):
        constant, name = (MeanRegressor, "mean") if task == "regression" else (MajorityClassifier, "majority")
        model = Pipeline(stages=[constant(labelCol=target)]).fit(train)
        return Fitted(model, name, list(features), None if estimator == "constant" else why)
    ready = stages(train, features, prep)
    holes = {c: n for c, n in facts.missing.items() if n and prep.refuses_missing(train.schema[c].dataType)}
    if holes:
        raise SchemaError(f"features have null values (rows): {holes}")
    data = train.select(*[F.col(f"`{c}`") for c in features], F.col(f"`{target}`"))
    if task == "regression":
        data = data.withColumn(target, F.col(f"`{target}`").cast("double"))
        if estimator == "linear":
            last = [linear_regression(target, params.solver)]
            return Fitted(Pipeline(stages=[*ready, *last]).fit(data), "linear", list(features))
        ensure_checkpoint_dir(train.sparkSession)
        return Fitted(
            Pipeline(stages=[*ready, boosted_regressor(target, params)]).fit(data), "boosted_regressor", list(features)
        )
    ensure_checkpoint_dir(train.sparkSession)
    labels = label_values(train, target, params.most_labels)
    kind = train.schema[target].dataType.simpleString()
    data = data.withColumn(target, F.col(f"`{target}`").cast("string"))
    model = Pipeline(stages=[*ready, *boosted_classifier(target, kind, labels, params)]).fit(data)
    model = PipelineModel(stages=[s for s in model.stages if not _codes_label(s)])
    return Fitted(model, "boosted_classifier" if len(labels) == 2 else "boosted_one_vs_rest", list(features))


def _nothing_to_learn(facts: Facts, estimator: str, task: str) -> str | None:
    if facts.n < 2:
        return "fewer than two rows"
    if not facts.varies:
        return "the label has one value"
    return "least squares fits numbers only" if estimator == "linear" and task != "regression" else None


def fit_anyway(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    task: str,
    estimator: str = "boosted",
    params: TreeParams = TreeParams(),
    prep: Preparation = Preparation(),
    facts: Facts | None = None,
) -> Fitted:
    """A model in spite of bad features, with the reason why it isn't the one asked for.

    The estimator is tried as asked, then with the tolerant assembler; for numbers
    least squares follows, at last the constant, which reads no feature. The
    reason names the first failure. A session that is gone ends the chain.
    """
    facts = facts or label_facts(train, target, features)
    tolerant = replace(prep, tolerant=True, impute=None, encode=False)
    attempts = [(estimator, prep), (estimator, tolerant)]
    if task == "regression" and estimator != "linear":
        attempts.append(("linear", tolerant))
    reason = None
    for name, how in attempts:
        try:
            fitted = fit(train, features, target, task, name, params, how, facts)
        except Exception as error:
            if session_gone(train.sparkSession):
                raise
            reason = reason or first_line(error)
            continue
        fitted.reason = reason or fitted.reason
        return fitted
    fitted = fit(train, features, target, task, "constant", params, prep, facts)
    fitted.reason = reason
    return fitted


def session_gone(spark: SparkSession) -> bool:
    context = spark.sparkContext
    return context._jsc is None or context._jsc.sc().isStopped()


def first_line(error: Exception) -> str:
    """One line that says what went wrong; errors of this library stand for themselves."""
    cause = getattr(error, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    said = str(cause.toString()) if cause is not None else str(error)
    first = (said.strip() or type(error).__name__).split("\n")[0]
    return first if isinstance(error, SchemaError) else f"{type(error).__name__}: {first}"


def _codes_label(stage) -> bool:
    """The label's indexer has no part in scoring: new labels must not fail there."""
    return isinstance(stage, StringIndexerModel) and stage.isSet(stage.outputCol) and stage.getOutputCol() == "label__code"


def label_values(train: DataFrame, target: str, most: int | None = None) -> list[str]:
    """Label values as text in the indexer's order; each gets a model, so they are few. ``most`` sets a limit."""
    found = train.select(F.col(f"`{target}`").cast("string").alias("l")).filter(F.col("l").isNotNull()).distinct()
    rows = (found if most is None else found.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise SchemaError(f"target {target} has over {most} labels; is it a number to regress on?")
    return sorted(r.l for r in rows)
