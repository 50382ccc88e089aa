"""Quality rules as a short-circuit cascade.

Each rule rejects or passes a text. A text is rejected as soon as one rule
rejects it, so the order of the rules changes the work and never the verdict.
The order comes from a bounded sample: each rule is timed on it, its rejections
are counted, and the rule with the most rejections per second goes first.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from trellium.llm.texts import WORD, annotate, keep_rows

SYMBOL = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(r"[^\W\d_]")
WINDOW = 5

# Rows on which cost and selectivity are estimated; they set the order only.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.05


class Text:
    """A text with features that are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def symbols(self) -> int:
        return len(SYMBOL.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def repeated_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated_words(self) -> int:
        """Words that lie in a window of five words found twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        covered = end = 0
        for at, window in enumerate(windows):
            if counts[window] > 1:
                covered += at + WINDOW - max(at, end)
                end = at + WINDOW
        return covered

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 10 or 100 * self.repeated_words > 20 * n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _too_few_words(t: Text) -> bool:
    return len(t.words) < 10


def _repeated_windows(t: Text) -> bool:
    return 100 * t.repeated_words > 20 * len(t.words)


def _symbols(t: Text) -> bool:
    return 4 * t.symbols > len(t.words)


def _repeated_lines(t: Text) -> bool:
    return len(t.lines) >= 4 and 10 * t.repeated_lines >= 4 * len(t.lines)


def _shouting(t: Text) -> bool:
    return len(t.words) >= 10 and 2 * sum(map(str.isupper, t.words)) > len(t.words)


def _exclamation(t: Text) -> bool:
    return 3 * t.text.count("!") > len(t.words)


def _long_words(t: Text) -> bool:
    """Blobs such as encoded files; scripts without blanks are long but not ASCII."""
    return t.text.isascii() and t.word_chars > 40 * len(t.words)


def _broken_characters(t: Text) -> bool:
    return 20 * t.text.count("�") > max(1, t.word_chars)


def _few_letters(t: Text) -> bool:
    return 5 * sum(1 for w in t.words if LETTER.search(w)) < len(t.words)


def _cut_lines(t: Text) -> bool:
    cut = sum(1 for line in t.lines if line.rstrip().endswith(("...", "…")))
    return len(t.lines) >= 4 and 10 * cut > 7 * len(t.lines)


def _one_word(t: Text) -> bool:
    return len(t.words) >= 20 and 2 * Counter(t.words).most_common(1)[0][1] > len(t.words)


RULES: tuple[Rule, ...] = (
    Rule("too_few_words", _too_few_words),
    Rule("repeated_windows", _repeated_windows),
    Rule("symbols", _symbols),
    Rule("repeated_lines", _repeated_lines),
    Rule("shouting", _shouting),
    Rule("exclamation", _exclamation),
    Rule("long_words", _long_words),
    Rule("broken_characters", _broken_characters),
    Rule("few_letters", _few_letters),
    Rule("cut_lines", _cut_lines),
    Rule("one_word", _one_word),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejections: int

    @property
    def gain(self) -> float:
        """Rejections per second; one is added so that the cheaper of two idle rules goes first."""
        return (self.rejections + 1) / max(self.seconds, 1e-9)


def estimate(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """Time and rejections of each rule on its own, words included where it needs them."""
    found = []
    for rule in rules:
        seconds, rejections = 0.0, 0
        for text in texts:
            fresh = Text(text)
            begin = time.perf_counter()
            rejections += rule.rejects(fresh)
            seconds += time.perf_counter() - begin
        found.append(Estimate(rule.name, seconds, rejections))
    return found


def sample_texts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most ``rows`` texts; from a random share of the rows, or the first ones of a small table."""
    column = docs.select(text)
    found = column.sample(SAMPLE_SHARE, seed=1).limit(rows).collect()
    if len(found) < rows // 4:
        found = column.limit(rows).collect()
    return [row[0] for row in found]


def order_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by falling rejections per cost."""
    gains = {e.name: e.gain for e in estimate(sample_texts(docs, text), rules)}
    return sorted(rules, key=lambda r: (-gains[r.name], r.name))


def cascade(order: Sequence[Rule], text: Text) -> str | None:
    """Name of the first rule that rejects, or None."""
    return next((rule.name for rule in order if rule.rejects(text)), None)


def measure_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, base measures, ``base_failed`` and ``kept``.

    A null text has no words and fails. Repeated rows and null ids stay rows;
    other columns of ``docs`` are not looked at. An empty table gives none.
    """
    order = order_rules(docs, text, rules)

    def start():
        def work(texts):
            rows = []
            for value in texts:
                t = Text(value)
                failed = t.base_failed
                rows.append((
                    len(t.words), t.word_chars, t.symbols, t.repeated_lines, t.repeated_words,
                    failed, not failed and cascade(order, t) is None,
                ))
            return list(zip(*rows)) or [[]] * 7

        return work

    return annotate(
        docs, [id], text,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
        start,
    )


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows of ``docs`` in all their columns that no rule rejects; nothing is shuffled."""
    order = order_rules(docs, text, rules)

    def start():
        return lambda texts: [cascade(order, Text(value)) is None for value in texts]

    return keep_rows(docs, text, start)
