"""What each stage has done, so that a message does its work once, whichever stream brings it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from trellium.sources.keyed_log import KeyedLog

SCHEMA = "stage string, key string, digest string, batch string, status string, output string, reason string, recorded_at timestamp"

DONE, REJECTED = "done", "rejected"


def digest_of(message: Mapping) -> str:
    """Equal for messages that are equal in all fields; one sent anew has another time."""
    plain = json.dumps(message, sort_keys=True, default=str)
    return hashlib.sha256(plain.encode()).hexdigest()


@dataclass(frozen=True)
class Entry:
    """The outcome of one message: what the stage sent on, or why it did not."""

    key: str | None
    digest: str
    output: dict | None = None
    reason: str | None = None

    @property
    def status(self) -> str:
        return DONE if self.reason is None else REJECTED


class Ledger:
    """Entries by stage, key and input digest, in the project's folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.log = KeyedLog(spark, f"{root.rstrip('/')}/ledger", SCHEMA, ["stage", "key", "digest"], ["recorded_at"])

    def read(self) -> DataFrame:
        return self.log.read()

    def seen(self, stage: str, digests: Iterable[str]) -> dict[str, tuple[str, Entry]]:
        """Batch and entry of the messages of this stage that were done before; rejects are tried again."""
        wanted = list(digests)
        if not wanted:
            return {}
        asked = self.spark.createDataFrame([(d,) for d in wanted], "digest string")
        rows = self.read().where(f"stage = '{stage}' and status = '{DONE}'").join(asked, "digest", "left_semi").collect()
        return {r.digest: (r.batch, Entry(r.key, r.digest, json.loads(r.output), r.reason)) for r in rows}

    def record(self, stage: str, batch: str, entries: Iterable[Entry]) -> None:
        """Write a batch's entries; writing the batch again replaces them."""
        now = datetime.now(timezone.utc)
        rows = [
            (stage, e.key, e.digest, batch, e.status, None if e.output is None else json.dumps(e.output, default=str), e.reason, now)
            for e in entries
        ]
        self.log.write(self.spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{stage}-{batch}")
        self.log.fold()


def once(ledger: Ledger | None, stage: str, batch: str, messages: list[dict], work: Callable[[list[dict]], list[Entry]]) -> list[Entry]:
    """Outcomes to send on for a batch of messages.

    A message that this stage has done in another batch is left out: its output
    was sent then. One done in this very batch, before the driver was lost, is
    sent again without its work. The others are worked on. The caller records the
    outcomes when all that follows from them is written.
    """
    by_digest = {digest_of(m): m for m in messages}
    before = {} if ledger is None else ledger.seen(stage, by_digest)
    again = [entry for at, entry in before.values() if at == batch]
    fresh = [m for d, m in by_digest.items() if d not in before]
    return again + (work(fresh) if fresh else [])
