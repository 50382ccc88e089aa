"""Where the file of a message is: the path it names, or its storage key under the project's root."""

from __future__ import annotations

import re
from collections.abc import Iterable
from multiprocessing.pool import ThreadPool

from pyspark.sql import SparkSession

from trellium.sources.folders import path_exists

# File systems asked side by side.
THREADS = 8
_ABSOLUTE = re.compile(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)")


def under(root: str, key: str) -> str:
    """A storage key as a path; a key that is a whole path or address stays."""
    return key if _ABSOLUTE.match(key) else f"{root.rstrip('/')}/{key}"


def csv_places(root: str, path: str | None, key: str | None, job_id: str | None) -> list[str]:
    """Places of an uploaded table, likeliest first.

    Uploads are stored under their job by the name they came with; a local copy
    has the time of its upload before the name.
    """
    path, key = (path or "").strip(), (key or "").strip()
    places = [path] if path else []
    if key:
        places.append(under(root, key))
    elif path and job_id:
        name = re.sub(r"^[0-9]+_", "", path.rstrip("/").rsplit("/", 1)[-1])
        places.append(under(root, f"uploads/{job_id}/{name}"))
    return list(dict.fromkeys(places))


def processed_places(root: str, path: str | None, key: str | None, job_id: str | None) -> list[str]:
    """Places of a cleaned table, likeliest first."""
    path, key = (path or "").strip(), (key or "").strip()
    places = [p for p in (path, under(root, key) if key else "") if p]
    if job_id:
        places.append(under(root, f"processed/{job_id}.parquet"))
    return list(dict.fromkeys(places))


def resolve(spark: SparkSession, places: list[str]) -> str | None:
    """The first place where something is; the first of all if there is nothing, None if there are no places.

    A single place isn't asked for: reading it tells.
    """
    if len(places) < 2:
        return places[0] if places else None
    return next((p for p in places if path_exists(spark, p)), places[0])


def resolve_all(spark: SparkSession, wanted: Iterable[list[str]]) -> list[str | None]:
    with ThreadPool(THREADS) as pool:
        return pool.map(lambda places: resolve(spark, places), list(wanted))
