"""Feature lists, on the driver for one frame and as array expressions for many jobs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns never used as features.
RESERVED = ("prediction", "id")
LABEL_NAMES = ("label", "target")


class SchemaError(ValueError):
    """The columns of a table do not fit the request."""


def fold(name: str) -> str:
    return name.strip().lower()


def folded_names(names: Iterable[str]) -> list[str]:
    """Folded names; two names that fold to one are an error, named in the message."""
    folded = [fold(n) for n in names]
    clashes = sorted(n for n, k in Counter(folded).items() if k > 1)
    if clashes:
        raise SchemaError(f"columns clash after folding names: {clashes}")
    return folded


def require_target(columns: Sequence[str], target: str | None) -> str:
    """Target as the table names it: the exact name first, then the folded one."""
    if not target or not target.strip():
        raise SchemaError("target column is required")
    if target in columns:
        return target
    if fold(target) in columns:
        return fold(target)
    raise SchemaError(f"target column '{target}' is not in the table")


def training_features(columns: Sequence[str], target: str) -> list[str]:
    dropped = {target, *RESERVED}
    features = [c for c in columns if c not in dropped]
    if not features:
        raise SchemaError("no feature column is left beside the target")
    return features


def reported_features(columns: Sequence[str]) -> list[str]:
    dropped = {*LABEL_NAMES, *RESERVED}
    return [c for c in columns if c not in dropped]


def scoring_features(
    columns: Sequence[str], configured: Sequence[str] | None, target: str | None
) -> list[str]:
    """The model's list when it has one, else everything that is not a label."""
    if configured:
        wanted = [fold(c) for c in configured]
        missing = [c for c in wanted if c not in columns]
        if missing:
            raise SchemaError(f"scoring table lacks feature columns: {missing}")
        return wanted
    dropped = {*RESERVED, fold(target)} if target else {*RESERVED, *LABEL_NAMES}
    features = [c for c in columns if c not in dropped]
    if not features:
        raise SchemaError("no feature column is available for scoring")
    return features


def prediction_name(columns: Sequence[str], target: str | None) -> str:
    name = fold(target or "")
    if not name:
        return "prediction"
    return f"{name}_predicted" if name in columns else name


def _without(columns: Column, dropped: Column) -> Column:
    return F.filter(columns, lambda c: ~F.array_contains(dropped, c))


def training_features_expr(columns: Column, target: Column) -> Column:
    return _without(columns, F.array(target, *[F.lit(c) for c in RESERVED]))


def reported_features_expr(columns: Column) -> Column:
    return _without(columns, F.array(*[F.lit(c) for c in (*LABEL_NAMES, *RESERVED)]))


def _known(configured: Column) -> Column:
    return F.coalesce(F.size(configured) > 0, F.lit(False))


def scoring_features_expr(columns: Column, configured: Column, target: Column) -> Column:
    reserved = F.array(*[F.lit(c) for c in RESERVED])
    labels = F.array(*[F.lit(c) for c in LABEL_NAMES])
    named = F.nullif(F.lower(F.trim(target)), F.lit(""))
    dropped = F.when(named.isNotNull(), F.concat(reserved, F.array(named))).otherwise(
        F.concat(reserved, labels)
    )
    listed = F.transform(configured, lambda c: F.lower(F.trim(c)))
    return F.when(_known(configured), listed).otherwise(_without(columns, dropped))


def missing_features_expr(columns: Column, configured: Column) -> Column:
    listed = F.transform(configured, lambda c: F.lower(F.trim(c)))
    return F.when(_known(configured), _without(listed, columns)).otherwise(
        F.array().cast("array<string>")
    )


def prediction_name_expr(columns: Column, target: Column) -> Column:
    name = F.nullif(F.lower(F.trim(target)), F.lit(""))
    return (
        F.when(name.isNull(), F.lit("prediction"))
        .when(F.array_contains(columns, name), F.concat(name, F.lit("_predicted")))
        .otherwise(name)
    )
