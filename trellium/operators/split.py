"""Train/test splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators.joins import broadcast_if_small
from trellium.functions.hashing import percent_bucket, split_digest
from trellium.functions.rows import holds_map, is_missing

# Test share in percent, and the seed.
TEST_PERCENT = 20
SEED = 42


def split_key(df: DataFrame, key: Sequence[str] | None = None) -> list[str]:
    """The given key, or ``id``, or every column."""
    if key:
        return list(key)
    return ["id"] if "id" in df.columns else list(df.columns)


def with_test_flag(
    df: DataFrame, key: Sequence[str] | None = None, test_percent: int = TEST_PERCENT, seed: int = SEED
) -> DataFrame:
    """Add ``is_test`` from a hash of the key: no shuffle, same rows on any partitioning.

    Near ``test_percent`` of every label as well, so it serves for stratified
    splits of large tables.
    """
    columns = [F.col(f"`{c}`") for c in split_key(df, key)]
    return df.withColumn("is_test", percent_bucket(split_digest(columns, seed)) < test_percent)


def random_split(df: DataFrame, test_percent: int = TEST_PERCENT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Spark's own split; its outcome depends on the partitioning."""
    share = test_percent / 100.0
    train, test = df.randomSplit([1.0 - share, share], seed)
    return train, test


def with_random_flag(df: DataFrame, test_percent: int = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    """``random_split`` as one table with ``is_test``."""
    train, test = random_split(df, test_percent, seed)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


def with_stratified_flag(
    df: DataFrame,
    label: str,
    key: Sequence[str] | None = None,
    test_percent: int = TEST_PERCENT,
    seed: int = SEED,
    unique_keys: bool = False,
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(share * n)`` of each label's n distinct keys.

    The keys with the smallest digests are the test keys; rows with equal keys
    stay on one side. Only the digest at each label's cut is looked for: digests
    are counted by their first four hex digits, the cut falls in one such bin,
    and only that bin's keys (1 in 65,536) are ordered. A label holding most of
    the rows is never gathered in one task.

    ``unique_keys`` says the keys hold no repeats and spares a shuffle.
    """
    columns = [F.col(f"`{c}`") for c in split_key(df, key)]
    digest = split_digest(columns, seed)
    keys = df.select(F.col(f"`{label}`").alias("_l"), digest.alias("_d"))
    if not unique_keys:
        keys = keys.distinct()
    keys = keys.withColumn("_bin", F.substring("_d", 1, 4))
    bins = keys.groupBy("_l", "_bin").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("_l")
    upto = by_label.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.ceil(F.sum("n").over(by_label) * test_percent / F.lit(100))
    cuts = (
        bins.withColumn("quota", quota)
        .withColumn("upto", F.sum("n").over(upto))
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(
            F.col("_l").alias("_cl"),
            F.col("_bin").alias("_cbin"),
            (F.col("quota") - (F.col("upto") - F.col("n"))).alias("rest"),
        )
    )
    cuts = broadcast_if_small(cuts)
    in_bin = keys.join(
        cuts, keys["_l"].eqNullSafe(cuts["_cl"]) & (keys["_bin"] == cuts["_cbin"]), "inner"
    )
    in_order = Window.partitionBy("_cl").orderBy("_d")
    last = (
        in_bin.withColumn("rank", F.row_number().over(in_order))
        .filter(F.col("rank") == F.col("rest"))
        .select(F.col("_cl"), F.col("_d").alias("_last"))
    )
    marked = df.join(broadcast_if_small(last), F.col(f"`{label}`").eqNullSafe(F.col("_cl")), "left")
    flag = F.coalesce(digest <= F.col("_last"), F.lit(False))
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], flag.alias("is_test"))


def holdout_counts(flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: ``n_train, n_test, holdout``. Without rows on both sides there is no hold-out."""
    counts = flagged.groupBy(*by).agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test")
    )
    return counts.withColumn("holdout", (F.col("n_train") > 0) & (F.col("n_test") > 0))


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    holdout: bool
    varies: bool | None = None  # does the label take more than one value in train?
    missing: dict[str, int] = field(default_factory=dict)  # rows of train without a value, per feature
    digest: str | None = None  # equal for equal sets of test keys


def train_test(
    flagged: DataFrame, label: str | None = None, features: Sequence[str] = (), key: Sequence[str] | None = None
) -> Split:
    """Both sides of a flagged table; test = train when one side is empty.

    One aggregate gives the counts, a digest of the test rows' keys and, for a
    ``label`` and ``features``, whether there is anything to learn and what is
    missing. Nothing is cached here: the caller knows whether the table fits.
    """
    y = F.lit(None) if label is None else F.col(f"`{label}`")
    side = F.col("is_test")
    keys = [c for c in split_key(flagged, key) if c != "is_test" and not holds_map(flagged.schema[c].dataType)]
    row = flagged.agg(
        F.count_if(~side).alias("train"),
        F.count_if(side).alias("test"),
        (F.min(F.when(~side, y)) < F.max(F.when(~side, y))).alias("varies_train"),
        (F.min(y) < F.max(y)).alias("varies_all"),
        F.sum(F.when(side, F.xxhash64(*[F.col(f"`{c}`") for c in keys]).cast("decimal(20,0)"))).alias("keys"),
        *[F.count_if(~side & is_missing(flagged, c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.count_if(is_missing(flagged, c)).alias(f"a{i}") for i, c in enumerate(features)],
    ).first()
    every = flagged.drop("is_test")

    def known(varies: bool | None) -> bool | None:
        return None if label is None else bool(varies)

    def missing(side: str) -> dict[str, int]:
        return {c: row[f"{side}{i}"] for i, c in enumerate(features)}

    if row.train == 0 or row.test == 0:
        n = row.train + row.test
        return Split(every, every, n, n, False, known(row.varies_all), missing("a"))
    return Split(
        flagged.filter(~side).drop("is_test"),
        flagged.filter(side).drop("is_test"),
        row.train,
        row.test,
        True,
        known(row.varies_train),
        missing("m"),
        f"{int(row['keys']) % (1 << 64):016x}",
    )
