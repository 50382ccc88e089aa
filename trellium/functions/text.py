"""Scalar expressions for names, keys, identifiers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TASK_TYPES = ("classification", "regression")

# The storage layout of a job's artifacts, in the order they appear;
# the place in the list is the rank of the status.
JOB_ARTIFACTS = ("uploads", "processed", "models")
STATUS_BY_RANK = {0: "queued", 1: "ingested", 2: "training", 3: "completed"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def none_if_blank(text: Column | str) -> Column:
    """Null when the text is empty or white space, else the trimmed text."""
    return F.nullif(strip(text), F.lit(""))


def first_non_empty(*candidates: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in candidates])


def task_type(*candidates: Column | str) -> Column:
    """First non-empty candidate, lower-cased; unknown or absent means classification."""
    chosen = F.lower(first_non_empty(*candidates))
    return F.when(chosen.isin(*TASK_TYPES), chosen).otherwise(F.lit("classification"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def strip_upload_prefix(name: Column | str) -> Column:
    """Remove the ``<millis>_`` that a stored upload carries before its name."""
    return F.regexp_replace(_c(name), r"^\d+_", "")


def is_csv_name(name: Column | str) -> Column:
    return F.lower(_c(name)).endswith(".csv")


def model_name(given: Column | str, file_name: Column | str) -> Column:
    """The given name, or the file name without its ``.csv``."""
    return F.coalesce(none_if_blank(given), F.regexp_replace(_c(file_name), r"(?i)\.csv$", ""))


def bare_model_id(model_id: Column | str) -> Column:
    """Model id without the file suffixes a caller may have left on it."""
    return F.replace(F.replace(_c(model_id), F.lit(".pkl.spark"), F.lit("")), F.lit(".pkl"), F.lit(""))


def artifact_key(kind: str, owner_id: Column | str, name: Column | str) -> Column:
    return F.concat_ws("/", F.lit(kind), _c(owner_id), _c(name))


# Every layout has its own pair of groups; a path that fits none leaves all of them empty.
_LAYOUT = (
    r"(?s)^(?:|.*?/)(?:(uploads)/([^/]+)/.*"
    r"|(processed)/([^/]+)\.parquet(?:/.*)?"
    r"|(models)/([^/]+)\.pkl\.meta"
    r"|(predictions_output)/(?:predict_id=([^/]+)/.*|([^/]+)\.csv(?:/.*)?))$|^.*$"
)


def artifact(path: Column | str) -> Column:
    """``struct(kind, id)`` of an artifact path by its layout; both empty when nothing fits.

    ``uploads/<id>/..``, ``processed/<id>.parquet``, ``models/<id>.pkl.meta``,
    ``predictions_output/<id>.csv`` or ``predictions_output/predict_id=<id>/..``,
    under any prefix. One pattern is matched once per path.
    """
    found = F.regexp_replace(_c(path), _LAYOUT, "$1$3$5$7/$2$4$6$8$9")
    return F.struct(
        F.substring_index(found, "/", 1).alias("kind"), F.substring_index(found, "/", -1).alias("id")
    )


def artifact_kind(path: Column | str) -> Column:
    return artifact(path)["kind"]


def artifact_id(path: Column | str) -> Column:
    return artifact(path)["id"]


def stable_id(*parts: Column | str) -> Column:
    """Id that a replayed micro-batch computes again, unlike ``uuid()``."""
    return F.sha2(F.concat_ws("\u0001", *[_c(p).cast("string") for p in parts]), 256)


def job_id_or_new(job_id: Column | str, *parts: Column | str) -> Column:
    fresh = stable_id(*parts) if parts else F.uuid()
    return F.coalesce(F.nullif(_c(job_id), F.lit("")), fresh)


def iso_time(ts: Column | str) -> Column:
    """ISO-8601 with microseconds and ``Z``; the session time zone should be UTC."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_now() -> Column:
    return iso_time(F.current_timestamp())


def parse_time(text: Column | str) -> Column:
    """ISO-8601 message time with milli- or microseconds; null when malformed."""
    return F.try_to_timestamp(_c(text))


def status_name(rank: Column | str) -> Column:
    r = F.coalesce(_c(rank), F.lit(0))
    expr = F.when(r == 0, F.lit(STATUS_BY_RANK[0]))
    for value in sorted(STATUS_BY_RANK)[1:]:
        expr = expr.when(r == value, F.lit(STATUS_BY_RANK[value]))
    return expr


def artifact_rank(kind: Column | str) -> Column:
    """1, 2, 3 for the artifacts of a job, 0 for any other."""
    return F.array_position(F.array(*[F.lit(k) for k in JOB_ARTIFACTS]), _c(kind)).cast("int")


def decoded_path(path: Column | str) -> Column:
    """Path as the user writes it; ``_metadata.file_path`` comes URL-encoded."""
    p = _c(path)
    return F.when(p.contains("%"), F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))).otherwise(p)


def plain_path(path: Column | str) -> Column:
    """Path without ``file:`` and trailing slashes, so that two spellings compare equal."""
    p = F.rtrim(_c(path), F.lit("/"))
    rest = F.ltrim(F.substr(p, F.lit(len("file:") + 1)), F.lit("/"))
    return F.when(p.startswith("file:/"), F.concat(F.lit("/"), rest)).otherwise(p)


def parent_folder(path: Column | str) -> Column:
    p = _c(path)
    return F.left(p, F.length(p) - F.length(base_name(p)) - 1)
