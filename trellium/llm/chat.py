"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. It
is rendered over the successive prefixes of a conversation; what an output adds
to the one before is the new turn's span. Two more renderings, with the new
text replaced by one probe character and by another, show where inside the span
the text begins and how much follows it. An output that doesn't begin with the
one before tells of a template that rewrites history: its spans are found again
in the last output where they still stand, and the turn at which it happened is
reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PROBES = ("\x01", "\x02")

# Turns before the one rendered, for templates declared to go turn by turn; see ``locate``.
WINDOW = 2

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Each ``<``, backslashes, ``|`` gets one more backslash, so no control string is left."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at a line break, so theirs are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def marked(turns: Sequence[Turn]) -> str:
    """The production template: marked turns, control strings inside texts escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """Turns of what ``marked`` made."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@dataclass
class Formatted:
    """``spans``: start and end of each turn; ``texts``: of its text; (-1, -1) where it can't be found again."""

    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewritten_at: list[int] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[low:middle], low):
            low = middle
        else:
            high = middle - 1
    return low


def _inner(render: Template, before: Sequence[Turn], role: str) -> tuple[int, int]:
    """Characters before the last turn's text, from the output's start, and after it."""
    one, two = (render([*before, (role, probe)]) for probe in PROBES)
    at = _common(one, two)
    return at, len(one) - at - 1


def _by_windows(render: Template, turns: Sequence[Turn], whole: str) -> Formatted | None:
    """Spans from renderings of the last few turns; None unless together they make the whole output."""
    result, parts, at = Formatted(whole), [], 0
    for k, (role, _) in enumerate(turns):
        before = turns[max(0, k - WINDOW) : k]
        old, new = render(before), render([*before, turns[k]])
        if not new.startswith(old):
            return None
        part = new[len(old) :]
        start, after = _inner(render, before, role)
        result.spans.append((at, at + len(part)))
        result.texts.append((at + start - len(old), at + len(part) - after))
        parts.append(part)
        at += len(part)
    head = render([])
    return result if not head and "".join(parts) == whole else None


def locate(render: Template, turns: Sequence[Turn], turn_by_turn: bool = False) -> Formatted:
    """Render a conversation and locate every turn and its text.

    All prefixes are rendered, at any number of turns, which takes time with the
    square of it. A caller who knows that the template writes each turn by itself
    may say so with ``turn_by_turn``: then windows of a few turns are rendered, in
    linear time; if they don't make up the whole output, the prefixes are.
    """
    whole = render(turns)
    if turn_by_turn and (quick := _by_windows(render, turns, whole)):
        return quick
    result = Formatted(whole)
    last = render([])
    pieces: list[tuple[str, int, int]] = []
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        begin = len(last)
        if not now.startswith(last):
            result.rewritten_at.append(k)
            begin = _common(now, last)
        start, after = _inner(render, turns[:k], role)
        start = min(max(start, begin), len(now))
        end = max(start, len(now) - after)
        result.spans.append((begin, len(now)))
        result.texts.append((start, end))
        pieces.append((now[begin:], start - begin, end - begin))
        last = now
    if result.rewritten_at:
        result.spans, result.texts = _find_again(pieces, whole)
    return result


def _find_again(pieces: Sequence[tuple[str, int, int]], whole: str) -> tuple[list, list]:
    """Places of the pieces in the last output, in order; a piece that was changed has none."""
    spans, texts, at = [], [], 0
    for piece, start, end in pieces:
        found = whole.find(piece, at) if piece else -1
        if found < 0:
            spans.append((-1, -1))
            texts.append((-1, -1))
        else:
            at = found + len(piece)
            spans.append((found, at))
            texts.append((found + start, found + end))
    return spans, texts


SCHEMA = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("turns", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType() if n == "role" else T.LongType()) for n in ("role", "start", "end", "text_start", "text_end")
    ]))),
    T.StructField("rewritten_at", T.ArrayType(T.LongType())),
])


def _gather(conversations: DataFrame, id: str) -> DataFrame:
    """One row per conversation with its turns in order."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    return conversations.groupBy(F.col(id)).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))


def format_conversations(conversations: DataFrame, render: Template = marked, id: str = "conv_id", turn_by_turn: bool = False) -> DataFrame:
    """One row per conversation: id, ``formatted``, ``turns`` with the spans of each, ``rewritten_at``.

    ``conversations`` has a row per turn: id, turn, role, text; other columns are
    not looked at. Turns go by ``turn`` (null first), then role and text;
    repeated rows are turns of their own. A null role or text counts as empty.
    Rows with a null id are one conversation. An empty table gives none.
    A conversation is one row of the result and has to fit in one.
    """
    gathered = _gather(conversations, id)
    out = T.StructType([gathered.schema[id], *SCHEMA.fields])

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, turns, rewritten = [], [], []
                for rows in part.column(1).to_pylist():
                    pairs = [(r["role"], r["text"]) for r in rows]
                    f = locate(render, pairs, turn_by_turn)
                    texts.append(f.text)
                    turns.append([
                        {"role": role, "start": s[0], "end": s[1], "text_start": t[0], "text_end": t[1]}
                        for (role, _), s, t in zip(pairs, f.spans, f.texts)
                    ])
                    rewritten.append(f.rewritten_at)
                made = [part.column(0), *(pa.array(v, type=arrow.field(i).type) for i, v in enumerate((texts, turns, rewritten), 1))]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return gathered.mapInArrow(run, out)


def loss_text(formatted: str, turns: Sequence[dict]) -> str:
    """What stands under the loss mask, unescaped."""
    return "".join(
        unescape(formatted[t["text_start"] : t["text_end"]]) for t in turns if t["role"] == LOSS_ROLE and t["text_start"] >= 0
    )


def read_back(formatted: DataFrame, id: str = "conv_id") -> DataFrame:
    """Digests of the turns and the loss text, from the formatted texts and the spans alone."""
    source = formatted.select(id, "formatted", "turns")
    out = T.StructType([source.schema[id], *T._parse_datatype_string(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ).fields])

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(out)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = loss_text(text, spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            made = [batch.column(0), *(pa.array(v, type=arrow.field(i).type) for i, v in enumerate(columns, 1))]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return source.mapInArrow(run, out)
