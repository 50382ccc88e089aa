"""Expressions on CSV text: fields of a record, open records, header names.

All quantifiers are possessive, so the expressions run in linear time and
constant stack on long records.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED_BODY = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = r',("' + _QUOTED_BODY + r'"?+[^,]*+|[^,]*+)'
_OPEN = (
    r'\A(?:(?:"' + _QUOTED_BODY + r'"[^,]*+|[^",][^,]*+|),)*+'
    r'"' + _QUOTED_BODY + r"\z"
)
# A number as a header test sees it.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def record_open(text: Column) -> Column:
    """True when the text ends inside a quoted field, so the next line belongs to it."""
    return text.rlike(_OPEN)


def csv_fields(record: Column) -> Column:
    """Fields of one record; a blank record has none."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def unquote(field: Column) -> Column:
        body = F.regexp_extract(field, r'^"(' + _QUOTED_BODY + r")", 1)
        tail = F.regexp_replace(field, r'^"' + _QUOTED_BODY + r'"?+', "")
        inner = F.replace(body, F.lit('""'), F.lit('"'))
        return F.when(field.startswith('"'), F.concat(inner, tail)).otherwise(field)

    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(raw, unquote))


def header_names(record: Column) -> Column:
    """Column names of a header record: trimmed, unquoted, empty ones left out."""
    def clean(field: Column) -> Column:
        trimmed = F.regexp_replace(field, r"^\s+|\s+$", "")
        return F.regexp_replace(F.regexp_replace(trimmed, '^"|"$', ""), r"^\s+|\s+$", "")

    return F.filter(F.transform(csv_fields(record), clean), lambda name: name != "")


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER)
