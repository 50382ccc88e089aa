"""A keyed table kept as a log: small parts, folded into numbered versions from time to time.

A part is written under a name of its own, so writing it again replaces it. The
newest row of a key counts, by the order columns and then all others, so a row
may stand in several parts without harm. One writer; readers at any time.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.rows import row_pick, unpack
from trellium.sources.folders import complete_children, delete_path, drop_old_versions, read_table, write_table

# Parts that may stand before they are folded.
PARTS = 16
# Streams of one driver may share a log; only one of them folds at a time.
_folding = threading.Lock()


class KeyedLog:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], order: Sequence[str] = ()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema: T.StructType = T._parse_datatype_string(schema)
        self.keys, self.order = list(keys), list(order)

    def write(self, rows: DataFrame, name: str) -> None:
        """Add or replace the part of this name."""
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.root}/parts/part-{name}")

    def parts(self) -> list[str]:
        """Complete parts by name."""
        return complete_children(self.spark, f"{self.root}/parts", "part-")

    def _rows(self, parts: Sequence[str]) -> DataFrame:
        base = read_table(self.spark, f"{self.root}/base")
        frames = [] if base is None else [base.select(*self.schema.fieldNames())]
        if parts:
            frames.append(self.spark.read.schema(self.schema).parquet(*[f"{self.root}/parts/{p}" for p in parts]))
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        rows = frames[0]
        for more in frames[1:]:
            rows = rows.unionByName(more)
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = self.schema.fieldNames()
        newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(row_pick(rows, "max", self.order).alias("r"))
        return newest.select(*unpack("r", names))

    def read(self) -> DataFrame:
        """The newest row of each key."""
        return self._newest(self._rows(self.parts()))

    def fold(self, most: int = PARTS) -> bool:
        """Fold the parts into a new version if there are more than ``most``; was it done?

        Folded parts stay until the next fold, for readers that hold them, so there
        are never more than twice as many. A fold that ends early is done again.
        """
        with _folding:
            return self._fold(most)

    def _fold(self, most: int) -> bool:
        names = self.parts()
        known = self._folded()
        fresh = [n for n in names if n not in known]
        if len(fresh) <= most:
            return False
        number = write_table(self._newest(self._rows(names)), f"{self.root}/base")
        done = self.spark.createDataFrame([(n,) for n in names], "name string")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/folded/v={number:09d}")
        for name in known:
            delete_path(self.spark, f"{self.root}/parts/{name}")
        for root in ("base", "folded"):
            drop_old_versions(self.spark, f"{self.root}/{root}", 2)
        return True

    def _folded(self) -> set[str]:
        """Parts that the newest version holds."""
        done = read_table(self.spark, f"{self.root}/folded")
        return set() if done is None else {r.name for r in done.collect()}
