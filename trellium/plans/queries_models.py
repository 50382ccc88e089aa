"""Registered queries: splits, metrics, estimators, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.operators import features as feat
from trellium.operators import metrics as met
from trellium.operators import models, scoring, split
from trellium.operators.baselines import MajorityClassifier, MeanRegressor
from trellium.plans import train
from trellium.plans.book import in_test, query, table
from trellium.operators.tolerant import TolerantAssembler
from trellium.sources import csv as files
from trellium.sources import registry as reg
from trellium.sources.catalog import Catalog
from trellium.sources.folders import new_folder

# Few and shallow trees: the checks ask whether boosting learns, not how far.
SMALL_TREES = models.TreeParams(trees=5, depth=4, rate=0.3)


@query(f"select o_orderkey, {in_test('o_orderkey')} as is_test from orders")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 by a hash of the key, no shuffle."""
    return split.with_test_flag(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("select count(*) as n_rows, true as near_share, 0::bigint as n_both from orders")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, random mode: both sides together are the table, no row is on both."""
    train, test = split.random_split(table(spark, sf_dir, "orders").select("o_orderkey"))
    sides = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    per_key = sides.groupBy("o_orderkey").agg(F.count_distinct("t").alias("sides"), F.sum("t").alias("t"), F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        (F.abs(F.sum("t") / F.sum("n") - 0.2) < 0.03).alias("near_share"),
        F.count_if(F.col("sides") > 1).alias("n_both"),
    )


@query(
    """
    select o_orderkey, o_orderstatus,
           row_number() over (partition by o_orderstatus order by md5(o_orderkey::varchar || '|42'))
             <= ceil(0.2 * count(*) over (partition by o_orderstatus)) as is_test
    from orders
    """
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a fifth of every label, without gathering a label in one task."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.with_stratified_flag(orders, "o_orderstatus", ["o_orderkey"], unique_keys=True)


@query(
    f"""
    select l_orderkey, count(*) filter (not t) as n_train, count(*) filter (t) as n_test,
           bool_or(t) and bool_or(not t) as holdout
    from (select l_orderkey, (('0x' || substr(md5(l_orderkey::varchar || '|' || l_linenumber::varchar || '|42'), 1, 8))::bigint % 100) < 20 as t
          from lineitem)
    group by l_orderkey
    """
)
def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a small table; without rows on both sides it has no hold-out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return split.holdout_counts(split.with_test_flag(lines, ["l_orderkey", "l_linenumber"]), ["l_orderkey"])


@query(
    f"""
    with s as (select o_totalprice / 100000 as y, {in_test('o_orderkey')} as t from orders),
         m as (select avg(y) as p from s where not t)
    select round(avg((y - p) ** 2), 6) as mse, round(sqrt(avg((y - p) ** 2)), 6) as rmse,
           round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) as r2, count(*) as n_samples
    from s, m where t
    """
)
def mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the training side, measured on the test side."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("y"))
    parts = split.train_test(split.with_test_flag(orders, ["o_orderkey"]))
    model = MeanRegressor(labelCol="y").fit(parts.train)
    got = met.regression_metrics(model.transform(parts.test), "y")
    return got.select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "r2")], "n_samples")


@query(
    f"""
    with s as (select quality, {in_test('doc_id')} as t from labels),
         m as (select quality as p from s where not t group by 1 order by count(*) desc, 1 limit 1)
    select round(avg((quality = p)::int), 6) as accuracy, count(*) as n_samples, any_value(p)::bigint as predicted
    from s, m where t
    """
)
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 A5 A9."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    parts = split.train_test(split.with_test_flag(labels, ["doc_id"]))
    model = MajorityClassifier(labelCol="quality").fit(parts.train)
    scored = model.transform(parts.test)
    got = met.classification_metrics(scored, "quality")
    value = int(model.getOrDefault(model.value))
    return got.select(F.round("accuracy", 6).alias("accuracy"), "n_samples", F.lit(value).cast("long").alias("predicted"))


@query(
    """
    select l_returnflag, l_linestatus as label, n from (
      select l_returnflag, l_linestatus, count(*) as n,
             row_number() over (partition by l_returnflag order by count(*) desc, l_linestatus) as rn
      from lineitem group by 1, 2)
    where rn = 1
    """
)
def majority_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 for many tables at once."""
    return met.majority_label(table(spark, sf_dir, "lineitem"), "l_linestatus", ["l_returnflag"])


@query("select l_quantity, count(*) as n from lineitem group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: counts per label value."""
    return met.value_counts(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(
    """
    select l_returnflag, count(*) as n_rows, count(distinct l_linenumber) as n_labels,
           round(avg(l_quantity_label), 6) as mean_label, count(distinct l_linenumber) > 1 as stratify
    from (select *, l_linenumber as l_quantity_label from lineitem) group by 1
    """
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, label count and mean in one aggregate."""
    got = met.label_summary(table(spark, sf_dir, "lineitem"), "l_linenumber", ["l_returnflag"])
    return got.withColumn("mean_label", F.round("mean_label", 6))


@query(
    """
    select l_returnflag, round(avg(e * e), 4) as mse, round(sqrt(avg(e * e)), 6) as rmse,
           round(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0), 6) as r2, count(*) as n_samples
    from (select l_returnflag, l_extendedprice / 1000 as y, l_extendedprice / 1000 - (50 + l_quantity / 10) as e from lineitem)
    group by 1
    """
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics in one aggregation, per group."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (50 + F.col("l_quantity") / 10).alias("prediction")
    )
    got = met.regression_metrics(lines, "y", by=["l_returnflag"])
    return got.select(
        "l_returnflag", F.round("mse", 4).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"), "n_samples"
    )


@query(
    """
    select round(avg((quality = (toxic = 0)::int)::int), 6) as accuracy, count(*) as n_samples from labels
    """
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    labels = table(spark, sf_dir, "labels").withColumn("prediction", (F.col("toxic") == 0).cast("int"))
    got = met.classification_metrics(labels, "quality")
    return got.select(F.round("accuracy", 6).alias("accuracy"), "n_samples")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a label that quantity and discount explain in part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000 + F.col("l_quantity")).alias("label"),
    )


_LINES_SQL = """
    l as (select l_orderkey, l_linenumber, l_quantity as quantity, l_discount as discount,
                 l_extendedprice * (1 - l_discount) / 1000 + l_quantity as label,
                 (('0x' || substr(md5(l_orderkey::varchar || '|' || l_linenumber::varchar || '|42'), 1, 8))::bigint % 100) < 20 as t
          from lineitem),
    c as (select avg(quantity) as mx, avg(discount) as mz, avg(label) as my,
                 var_pop(quantity) as vx, var_pop(discount) as vz, covar_pop(quantity, discount) as vxz,
                 covar_pop(quantity, label) as vxy, covar_pop(discount, label) as vzy
          from l where not t),
    w as (select (vxy * vz - vzy * vxz) / (vx * vz - vxz * vxz) as b1,
                 (vzy * vx - vxy * vxz) / (vx * vz - vxz * vxz) as b2, mx, mz, my from c),
    b as (select b1, b2, my - b1 * mx - b2 * mz as b0 from w)
"""
_FEATURES = ["quantity", "discount"]


def _split_lines(spark: SparkSession, sf_dir: str) -> split.Split:
    return split.train_test(split.with_test_flag(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"]), "label")


def _fit_line(parts: split.Split) -> models.Fitted:
    facts = models.Facts(parts.n_train, bool(parts.varies), parts.missing)
    return models.fit(parts.train, _FEATURES, "label", "regression", "linear", facts=facts)


@query(f"with {_LINES_SQL} select round(b0, 4) as intercept, round(b1, 4) as quantity, round(b2, 4) as discount from b")
def linreg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares in one aggregation pass, against the closed form."""
    fitted = _fit_line(_split_lines(spark, sf_dir))
    ols = fitted.model.stages[-1]
    row = [float(ols.intercept), *[float(c) for c in ols.coefficients]]
    return spark.createDataFrame([row], "intercept double, quantity double, discount double").select(
        *[F.round(c, 4).alias(c) for c in ("intercept", *_FEATURES)]
    )


@query(
    f"""
    with {_LINES_SQL}
    select l_orderkey, l_linenumber::bigint as l_linenumber, quantity, discount,
           round(b0 + b1 * quantity + b2 * discount, 3) as label_predicted
    from l, b where t
    """
)
def linreg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save, load, score the test side, write CSV, read it back."""
    parts = _split_lines(spark, sf_dir)
    fitted = _fit_line(parts)
    saved, out = new_folder(spark, "model"), new_folder(spark, "scored")
    fitted.model.write().overwrite().save(saved)
    meta = {"target_column": "label", "feature_cols": _FEATURES}
    scored = scoring.score(PipelineModel.load(saved), parts.test, meta)
    files.write_csv(scored.drop("label"), out)
    kinds = "l_orderkey bigint, l_linenumber bigint, quantity double, discount double, label_predicted double"
    back = files.read_training_csv(spark, out, schema=spark.createDataFrame([], kinds).schema)
    return back.withColumn("label_predicted", F.round("label_predicted", 3))


@query(
    f"""
    with {_LINES_SQL}, e as (select label as y, label - (b0 + b1 * quantity + b2 * discount) as e from l, b where t)
    select round(avg(e * e), 4) as mse, round(sqrt(avg(e * e)), 5) as rmse,
           round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) as r2, count(*) as n_samples
    from e
    """
)
def linreg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear model on the hold-out."""
    parts = _split_lines(spark, sf_dir)
    fitted = _fit_line(parts)
    scored = scoring.score(fitted.model, parts.test, {"target_column": "label", "feature_cols": _FEATURES})
    got = met.regression_metrics(scored, "label", "label_predicted")
    return got.select(F.round("mse", 4).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("r2", 6).alias("r2"), "n_samples")


def id_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines with one key column, as a table to train on."""
    return _lines(spark, sf_dir).select(
        F.concat_ws("|", "l_orderkey", "l_linenumber").alias("id"), "quantity", "discount", "label"
    )


_TESTED_LINES = """
    from lineitem
    where (('0x' || substr(md5(l_orderkey::varchar || '|' || l_linenumber::varchar || '|42'), 1, 8))::bigint % 100) < 20
"""


def _trained_and_reloaded(table_: DataFrame, task: str, params: models.TreeParams, metric: str, floor: float) -> DataFrame:
    """Train with the job's own steps, save, load, and score the test side with both models."""
    trained = train.train_table(table_, "label", task, train.TrainOptions("boosted", params))
    saved = new_folder(table_.sparkSession, "model")
    trained.fitted.model.write().overwrite().save(saved)
    test = split.with_test_flag(table_, ["id"]).filter("is_test").drop("is_test")
    meta = {"target_column": "label", "feature_cols": _FEATURES}
    first = scoring.score(trained.fitted.model, test, meta).withColumnRenamed("label_predicted", "p")
    again = scoring.score(PipelineModel.load(saved), first, meta)
    return again.agg(
        F.count("p").alias("n_scored"),
        F.lit(trained.fitted.estimator).alias("estimator"),
        F.lit(trained.metrics[metric] > floor).alias("learnt"),
        F.bool_and(F.col("p") == F.col("label_predicted")).alias("same_after_reload"),
    )


@query(f"select count(*) as n_scored, 'boosted_regressor' as estimator, true as learnt, true as same_after_reload {_TESTED_LINES}")
def boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees explain most of the label, and the saved model scores the same."""
    lines = id_lines(spark, sf_dir).withColumn(
        "label", F.col("quantity") * (2 - F.col("discount")) + F.col("label") / 100
    )
    return _trained_and_reloaded(lines, "regression", SMALL_TREES, "r2", 0.5)


@query(f"select count(*) as n_scored, 'boosted_classifier' as estimator, true as learnt, true as same_after_reload {_TESTED_LINES}")
def boosted_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with two text labels."""
    lines = id_lines(spark, sf_dir).withColumn(
        "label", F.when(F.col("quantity") + 100 * F.col("discount") > 30, "high").otherwise("low")
    )
    return _trained_and_reloaded(lines, "classification", SMALL_TREES, "accuracy", 0.8)


@query(f"select count(*) as n_scored, 'boosted_one_vs_rest' as estimator, true as learnt, true as same_after_reload {_TESTED_LINES}")
def boosted_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with three number labels: one model against the rest each, labels keep their type."""
    lines = id_lines(spark, sf_dir).withColumn(
        "label", F.when(F.col("quantity") > 33, 10).when(F.col("quantity") > 16, 20).otherwise(30)
    )
    few = models.TreeParams(trees=2, depth=3, rate=0.5)
    return _trained_and_reloaded(lines, "classification", few, "accuracy", 0.8)


@query(
    """
    select 'constant number' as given, 'mean' as estimator, count(*) as n_scored from lineitem
    union all select 'constant class', 'majority', count(*) from lineitem
    union all select 'varying number', 'linear', count(*) from lineitem
    union all select 'no rows', 'mean', count(*) from lineitem
    """
)
def estimator_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels decide whether there is anything to fit."""
    lines = _lines(spark, sf_dir)
    cases = [
        ("constant number", lines.withColumn("label", F.lit(3.5)), "regression", "boosted"),
        ("constant class", lines.withColumn("label", F.lit("one")), "classification", "boosted"),
        ("varying number", lines, "regression", "linear"),
        ("no rows", lines.filter(F.col("quantity") < 0), "regression", "boosted"),
    ]
    out = None
    for given, train, task, wanted in cases:
        fitted = models.fit(train, _FEATURES, "label", task, wanted)
        scored = scoring.score(fitted.model, lines, {"target_column": "label", "feature_cols": _FEATURES})
        part = scored.agg(F.count("label_predicted").alias("n_scored")).select(
            F.lit(given).alias("given"), F.lit(fitted.estimator).alias("estimator"), "n_scored"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what user tables hold: nulls, dates, texts, equal columns."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("gap"),
        F.col("o_custkey").cast("double").alias("whole"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("day"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("word"),
        F.col("o_totalprice").alias("label"),
    )


@query(
    """
    with o as (select o_orderkey as id, case when o_orderkey % 5 <> 0 then o_totalprice end as gap, o_custkey::double as whole,
                      case when o_orderkey % 7 <> 0 then o_orderdate end as day,
                      case when o_orderkey % 3 <> 0 then o_orderpriority end as word from orders),
    f as (select avg(gap) as gap, avg(date_diff('day', date '1970-01-01', day::date)) as day, count(*) as n from o),
    w as (select word, count(*) as k from o where word is not null group by 1)
    select id, round(coalesce(o.gap, f.gap), 3) as gap, (o.gap is null)::double as gap_missing, whole,
           round(coalesce(date_diff('day', date '1970-01-01', o.day::date)::double, f.day), 3) as day, (o.day is null)::double as day_missing,
           round(coalesce(w.k / f.n, 0), 6) as word, (o.word is null)::double as word_missing
    from o cross join f left join w on w.word = o.word
    """
)
def tolerant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled numbers with marks, dates as days, texts as shares."""
    rows = _gaps(spark, sf_dir)
    model = TolerantAssembler(inputCols=["gap", "whole", "day", "word"]).fit(rows)
    cells = vector_to_array("features")
    names = ["gap", "gap_missing", "whole", "day", "day_missing", "word", "word_missing"]
    digits = {"gap": 3, "day": 3, "word": 6}
    return model.transform(rows).select(
        "id", *[F.round(cells[i], digits[c]).alias(c) if c in digits else cells[i].alias(c) for i, c in enumerate(names)]
    )


@query(
    """
    with n as (select count(*) as n, count(*) filter (o_orderkey % 5 = 0) as gaps from orders)
    select given, estimator, reason, case when given = 'one row' then 1 else n end as n_scored from n, lateral (values
        ('as asked', 'linear', null),
        ('null', 'linear', 'features have null values (rows): {''gap'': ' || gaps || '}'),
        ('date', 'linear', 'features of these types can''t be assembled: {''day'': ''date''}'),
        ('text', 'linear', 'text features need encoding: [''word'']'),
        ('singular', 'linear', null),
        ('constant', 'mean', 'the label has one value'),
        ('one row', 'mean', 'fewer than two rows'),
        ('no usable feature', 'mean', 'features of these types can''t be assembled: {''list'': ''array<bigint>''}')
    ) t(given, estimator, reason)
    """
)
def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in spite of bad features, its reason kept in the registry and read back; every row is scored."""
    rows = _gaps(spark, sf_dir)
    twin = rows.withColumn("twin", 2 * F.col("whole"))
    cases = {
        "as asked": (rows, ["whole"]),
        "null": (rows, ["gap", "whole"]),
        "date": (rows, ["whole", "day"]),
        "text": (rows, ["whole", "word"]),
        "singular": (twin, ["whole", "twin"]),
        "constant": (rows.withColumn("label", F.lit(2.5)), ["whole"]),
        "one row": (rows.join(rows.agg(F.min("id").alias("id")), "id"), ["whole"]),
        "no usable feature": (rows.withColumn("list", F.array("id")), ["list"]),
    }
    root = new_folder(spark, "registry")
    out = None
    for given, (data, features) in cases.items():
        fitted = models.fit_anyway(data, features, "label", "regression", "linear")
        row = reg.registry_row(
            given, spark_path="", feature_cols=features, feature_types={}, task_type="regression", target_column="label",
            estimator=fitted.estimator, reason=fitted.reason,
        )
        reg.save_rows(spark.createDataFrame([row], reg.REGISTRY), root)
        scored = scoring.score(fitted.model, data, {"target_column": "label", "feature_cols": features})
        part = scored.agg(F.count("label_predicted").alias("n_scored")).withColumn("given", F.lit(given))
        out = part if out is None else out.unionByName(part)
    known = reg.read_registry(spark, root).select(F.col("model_id").alias("given"), "estimator", "reason")
    return known.join(out, "given").select("given", "estimator", "reason", "n_scored")


@query(
    f"""
    with n as (select count(*) filter (t) as held, count(*) as n from (select {in_test('o_orderkey')} as t from orders))
    select 'many' as job_id, metric_name, true as holdout, 0::bigint as n_unscored, true as has_digest,
           case when metric_name = 'n_samples' then held::double end as counted from n, (values ('mse'), ('rmse'), ('r2'), ('n_samples')) m(metric_name)
    union all
    select 'two', metric_name, false, 0, false, case when metric_name = 'n_samples' then 2.0 end from (values ('mse'), ('rmse'), ('r2'), ('n_samples')) m(metric_name)
    """
)
def metrics_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics say whether they are of held-out rows, how many had no estimate, and of which split."""
    rows = _gaps(spark, sf_dir).select("id", "whole", "gap", "label")
    # Two keys that the hash puts on the training side, so there is nothing to hold out.
    train_side = split.with_test_flag(rows, ["id"]).where(~F.col("is_test")).drop("is_test")
    layout = train.Layout(new_folder(spark, "project"))
    for job, data in (("many", rows), ("two", train_side.orderBy("id").limit(2))):
        trained = train.train_table(data, "label", "regression", train.TrainOptions("linear"))
        trained.job_id = job
        train.record(spark, [trained], layout)
    found = Catalog(spark, layout.catalog).read("metrics")
    return found.select(
        "job_id", "metric_name", "holdout", "n_unscored", F.col("split_digest").isNotNull().alias("has_digest"),
        F.when(F.col("metric_name") == "n_samples", F.col("metric_value")).alias("counted"),
    )


@query(
    """
    with c as (select c_custkey, case when c_mktsegment <> 'BUILDING' then c_acctbal end as bal from customer),
         f as (select c_custkey, coalesce(bal, (select avg(bal) from c)) as bal from c),
         s as (select avg(bal) as m, stddev_samp(bal) as d from f)
    select c_custkey, round(bal, 4) as filled, round((bal - m) / d, 5) as scaled from f, s
    """
)
def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean imputation, then z-scores."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("bal")
    )
    prep = feat.Preparation(impute="mean", scale=True)
    ready = Pipeline(stages=feat.stages(customers, ["bal"], prep)).fit(customers).transform(customers)
    return ready.select(
        "c_custkey",
        F.round("bal__filled", 4).alias("filled"),
        F.round(vector_to_array("features")[0], 5).alias("scaled"),
    )


@query(
    """
    with n as (select o_orderpriority as v, row_number() over (order by count(*) desc, o_orderpriority) - 1 as code
               from orders group by 1)
    select o_orderkey, code::bigint as code, o_totalprice as price
    from orders join n on v = o_orderpriority
    """
)
def encode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to codes by frequency, then one column per code."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    prep = feat.Preparation(encode=True)
    ready = Pipeline(stages=feat.stages(orders, ["o_orderpriority", "o_totalprice"], prep)).fit(orders).transform(orders)
    cells = vector_to_array("features")
    hot = F.slice(cells, 1, F.size(cells) - 1)
    return ready.select(
        "o_orderkey", (F.array_position(hot, F.lit(1.0)) - 1).cast("long").alias("code"), F.element_at(cells, -1).alias("price")
    )


@query(
    f"""
    with s as (select l_orderkey, l_linenumber::bigint as l_linenumber, l_extendedprice as price from lineitem)
    select l_orderkey, l_linenumber, price from s order by price desc, l_orderkey, l_linenumber limit 5
    """
)
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the first five rows of one scored table, as a top-k."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_extendedprice").alias("price")
    )
    return scoring.top_rows(lines, [F.desc("price"), "l_orderkey", "l_linenumber"])
