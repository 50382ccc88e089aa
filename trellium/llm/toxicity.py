"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols. An insult and a threat machine read words and phrases from
left to right. A target machine reads the symbols from right to left and marks
hits that a target follows. Then negation, reported speech, targets before a hit,
passive threats and speakers are read from left to right, and a last machine
weighs what is marked. The machines of each direction are composed into one. A
text's features come from the weights of its clauses; a logistic regression on
them gives the score. Insult words come from a short list and from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.texts import annotate, slices
from trellium.llm.work import Work, work

# Labelled rows that lexicon and regression are fitted on at most: those with the smallest hash of the id.
TRAINING_ROWS = 30_000
# Bytes of learned words and word beginnings that may be broadcast; a larger lexicon is an error, never cut.
LEXICON_BYTES = 128 << 20
# Evidence (twice the log-likelihood ratio against the share of toxic texts) that a learned word needs.
EVIDENCE = 24.0
PRECISION = 0.75
STEMS = (4, 5, 6, 7)
HELD_UNITS = 200_000

TOKEN = re.compile(r"[^\W\d_]+|[.!?;,\n\"“”«»]")
PLAIN_WORD = re.compile(r"[^\W\d_]+")

# Words and phrases of the grammar.
INSULTS = frozenset("""
idiot idiots moron morons stupid loser losers scum trash worthless disgusting pathetic clown dumb fool imbecile filth
vermin ugly useless coward liar freak parasite subhuman bastard jerk creep degenerate
dummkopf abschaum versager wertlos idiota estúpido imbécil basura crétin ordure minable
""".split())
INSULT_PHRASES = (
    "piece of garbage", "piece of trash", "piece of filth", "waste of space", "waste of oxygen", "waste of skin", "good for nothing",
    "shut up", "go to hell", "drop dead", "get lost", "halt die klappe", "halt den mund", "hijo de puta", "vete al infierno",
    "ferme ta gueule", "ta gueule", "va au diable",
)
THREATS = frozenset("""
kill killed hurt destroy destroyed beat beaten punch punched stab stabbed shoot shot burn burned hang hanged smash strangle murder
murdered töten umbringen schlagen erschießen matar golpear tuer frapper
""".split())
# Threats that name their target themselves.
THREAT_PHRASES = (
    "watch your back", "break your neck", "cut your throat", "slit your throat", "end your life", "make you suffer", "make you pay",
    "you will regret", "you are dead", "ich bring dich um", "te voy a romper", "tu vas mourir",
)
TARGETS = frozenset("""
you your yours yourself they them he him she her people everyone
du ihr sie ihnen tú usted ustedes ellos eux ils elles
""".split())
# Targets that may stand before the verb whose object they are.
OBJECTS = frozenset("dich euch ihn te os vous toi".split())
SPEAKERS = frozenset("i we ich wir yo nosotros je nous".split())
PASSIVES = frozenset("be get".split())
NEGATIONS = frozenset("not no never neither nor nobody isn aren don doesn nicht kein keine nie nunca jamás pas jamais".split())
REPORTS = frozenset("""
said says say wrote writes claimed claims called calls quoted quote reported reports accused alleged
sagte schrieb nannte dijo escribió llamó dit écrit appelé
""".split())
ENDS = frozenset(".!?;\n")
QUOTES = frozenset("\"“”«»")

# Words over which a negation, a target, an object before its verb and a passive reach.
NEGATION_SCOPE = 3
TARGET_SCOPE = 4
OBJECT_SCOPE = 3
PASSIVE_SCOPE = 2
# A hit that ends a clause of so many words is a call.
CALL_WORDS = 3

Symbol = str


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state and the symbol written."""

    start: object
    step: Callable[[object, Symbol], tuple[object, Symbol]]


def compose(*machines: Transducer) -> Transducer:
    """The machine that feeds what each machine writes to the next."""

    def step(states, symbol):
        after = []
        for machine, state in zip(machines, states):
            state, symbol = machine.step(state, symbol)
            after.append(state)
        return tuple(after), symbol

    return Transducer(tuple(m.start for m in machines), step)


# An input symbol is I, H, T, D (a target that may stand before its verb), S, B, N, R, Q, "," or O. Words of phrases
# are written before it, as in "your=T". A hit is I or H; marks are added to it in small letters.


def phrase_machine(phrases: Sequence[str], hit: Symbol) -> Transducer:
    """Writes ``hit`` at the last word of a phrase; its state is the longest beginning of a phrase just read."""
    whole = {tuple(p.split()) for p in phrases}
    beginnings = {p[:n] for p in whole for n in range(len(p))}

    def step(read: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
        word, known, _ = symbol.partition("=")
        if not known:
            return (), symbol
        read = (*read, word)
        done = any(read[i:] in whole for i in range(len(read)))
        while read not in beginnings:
            read = read[1:]
        return read, f"{word}={hit}" if done else symbol

    return Transducer((), step)


def _plain(state: None, symbol: Symbol) -> tuple[None, Symbol]:
    return state, symbol.rpartition("=")[2]


def _is_hit(symbol: Symbol) -> bool:
    return symbol[0] in "IH"


def _target_after(state: tuple[int, bool], symbol: Symbol) -> tuple[tuple[int, bool], Symbol]:
    """From right to left: ``a`` for a target after the hit, ``e`` for a hit that ends the clause."""
    left, inside = state
    if symbol in "TD":
        return (TARGET_SCOPE, True), symbol
    if symbol == ",":
        return (0, True), symbol
    if _is_hit(symbol):
        symbol += "a" * bool(left) + "e" * (not inside)
    return (max(0, left - 1), inside or symbol != "Q"), symbol


def _negation(left: int, symbol: Symbol) -> tuple[int, Symbol]:
    if symbol == "N":
        return NEGATION_SCOPE, symbol
    if symbol == ",":
        return 0, symbol
    return max(0, left - 1), symbol + "n" if left and _is_hit(symbol) else symbol


def _reported(state: tuple[bool, bool], symbol: Symbol) -> tuple[tuple[bool, bool], Symbol]:
    said, quoted = state
    if symbol == "R":
        return (True, quoted), symbol
    if symbol == "Q":
        return (said, not quoted), symbol
    return state, symbol + "r" if _is_hit(symbol) and (said or quoted) else symbol


def _target_before(left: int, symbol: Symbol) -> tuple[int, Symbol]:
    if symbol in "TD":
        return TARGET_SCOPE, symbol
    return max(0, left - 1), symbol + "t" if left and _is_hit(symbol) else symbol


def _object_before(left: int, symbol: Symbol) -> tuple[int, Symbol]:
    if symbol == "D":
        return OBJECT_SCOPE, symbol
    if symbol == ",":
        return 0, symbol
    return max(0, left - 1), symbol + "d" if left and symbol[0] == "H" else symbol


def _passive(state: tuple[bool, int], symbol: Symbol) -> tuple[tuple[bool, int], Symbol]:
    """``p`` for a threat after a target and a helper, as in "they will be shot"."""
    target, left = state
    if symbol in "TD":
        return (True, max(0, left - 1)), symbol
    if symbol == "B":
        return (target, PASSIVE_SCOPE if target else 0), symbol
    return (target, max(0, left - 1)), symbol + "p" if left and symbol[0] == "H" else symbol


def _speaker(seen: bool, symbol: Symbol) -> tuple[bool, Symbol]:
    return seen or symbol == "S", symbol + "s" if seen and symbol[0] == "H" else symbol


def _call(words: int, symbol: Symbol) -> tuple[int, Symbol]:
    words = min(CALL_WORDS + 1, words + (symbol not in ",Q"))
    return words, symbol + "c" if _is_hit(symbol) and "e" in symbol and words <= CALL_WORDS else symbol


# Weights of hits, and factors of negation and reported speech.
AIMED, SPOKEN, CALLED, PILED, ALONE = 1.5, 2.0, 1.2, 1.0, 0.4
FACTORS = {"n": 0.2, "r": 0.5}


def _weigh(hits: bool, symbol: Symbol) -> tuple[bool, Symbol]:
    """Writes a hit's weight as text. A threat counts only against a target; an insult alone counts little."""
    marks = symbol[1:]
    if symbol[0] == "H" and set(marks) & set("adp"):
        weight = SPOKEN if "s" in marks else AIMED
    elif symbol[0] == "I":
        weight = AIMED if set(marks) & set("at") else CALLED if "c" in marks else PILED if hits else ALONE
    else:
        return hits, "0"
    for mark, factor in FACTORS.items():
        weight *= factor if mark in marks else 1
    return True, repr(weight)


class Machine:
    """A transducer as a table, filled as states are met."""

    def __init__(self, transducer: Transducer):
        self.start = transducer.start
        self.transducer = transducer
        self.table: dict[tuple[object, Symbol], tuple[object, Symbol]] = {}

    def run(self, symbols: Iterable[Symbol]) -> list[Symbol]:
        state, out = self.start, []
        for symbol in symbols:
            found = self.table.get((state, symbol))
            if found is None:
                found = self.table[state, symbol] = self.transducer.step(state, symbol)
            state, written = found
            out.append(written)
        return out


class Grammar:
    """The three passes over a clause."""

    def __init__(self):
        self.hits = Machine(compose(phrase_machine(INSULT_PHRASES, "I"), phrase_machine(THREAT_PHRASES, "Ha"), Transducer(None, _plain)))
        self.behind = Machine(Transducer((0, False), _target_after))
        self.weights = Machine(compose(
            Transducer(0, _negation), Transducer((False, False), _reported), Transducer(0, _target_before), Transducer(0, _object_before),
            Transducer((False, 0), _passive), Transducer(False, _speaker), Transducer(0, _call), Transducer(False, _weigh),
        ))

    def clause(self, symbols: Sequence[tuple[Symbol, float]]) -> float:
        """Sum over the clause's hits of their word's weight times the weight that the grammar gives."""
        hits = self.hits.run([s for s, _ in symbols])
        if not any(_is_hit(s) for s in hits):
            return 0.0
        behind = self.behind.run(reversed(hits))
        marked = self.weights.run(reversed(behind))
        return sum(float(f) * w for f, (_, w) in zip(marked, symbols) if f != "0")


def grammar() -> Grammar:
    return Grammar()


PHRASE_WORDS = frozenset(w for p in (*INSULT_PHRASES, *THREAT_PHRASES) for w in p.split())
LAST_WORDS = frozenset(p.split()[-1] for p in (*INSULT_PHRASES, *THREAT_PHRASES))
SYMBOLS = (
    ("H", THREATS), ("N", NEGATIONS), ("D", OBJECTS), ("T", TARGETS), ("S", SPEAKERS), ("B", PASSIVES), ("R", REPORTS),
    ("Q", QUOTES), (",", frozenset(",")),
)


class Lexicon(dict):
    """Symbol and weight of each lower-case word, looked up once per word."""

    LIMIT = 100_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[Symbol, float]:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        if word in INSULTS:
            weight = max(weight, 1.0)
        symbol = "I" if weight else next((symbol for symbol, words in SYMBOLS if word in words), "O")
        found = (f"{word}={symbol}" if word in PHRASE_WORDS else symbol, weight or 1.0)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


N_FEATURES = 6
# Weight from which a clause counts as matched.
MATCH = 0.5


def features(text: str | None, lexicon: Lexicon, machine: Grammar) -> list[float]:
    """Sum and largest of the clause weights, share of matched clauses, weight per word, one match, two or more."""
    lower = (text or "").lower()
    words = PLAIN_WORD.findall(lower)
    if not any(w in LAST_WORDS or lexicon[w][0][-1] in "IH" for w in set(words)):
        return [0.0] * N_FEATURES
    clauses, clause = [], []
    for token in TOKEN.findall(lower):
        if token in ENDS:
            if clause:
                clauses.append(machine.clause(clause))
            clause = []
        else:
            clause.append(lexicon[token])
    if clause:
        clauses.append(machine.clause(clause))
    total = sum(clauses)
    matched = sum(1 for c in clauses if c >= MATCH)
    return [
        math.log1p(total), min(3.0, max(clauses, default=0.0)), matched / max(1, len(clauses)),
        math.log1p(1000 * total / len(words)), float(matched >= 1), float(matched >= 2),
    ]


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...]
    intercept: float


# Used where no labelled rows of both kinds exist.
UNTRAINED = ((1.0, 1.0, 1.0, 0.5, 0.0, 0.0), -3.0)


def held_out(id: str) -> F.Column:
    """Rows whose label must not be learned."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled texts; equal texts are one, toxic if most of their labels are."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col(id).isNotNull() & ~held_out(id))
        .groupBy(id).agg(F.max("toxic").alias("__toxic"))
        .orderBy(F.xxhash64(id), id).limit(rows)
    )
    texts = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    return (
        texts.join(F.broadcast(known), id)
        .groupBy(F.sha2(F.col("__text").cast("binary"), 256).alias("h"))
        .agg(F.min("__text").alias("text"), (F.avg("__toxic") >= 0.5).cast("int").alias("toxic"))
        .where(F.col("text").isNotNull()).select("text", "toxic")
    )


def _units(rows: DataFrame) -> DataFrame:
    """Per word and word beginning: texts with it, and toxic ones; folded in the tasks first, ``HELD_UNITS`` at a time."""

    def run(batches):
        import pyarrow as pa

        seen, toxic = Counter(), Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({
                "unit": pa.array(list(seen), pa.string()),
                "n": pa.array(list(seen.values()), pa.int64()),
                "n_toxic": pa.array([toxic[u] for u in seen], pa.int64()),
            })
            seen.clear()
            toxic.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = set(PLAIN_WORD.findall(text.lower()))
                    units = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                    seen.update(units)
                    if label:
                        toxic.update(units)
                    if len(seen) > HELD_UNITS:
                        yield flush()
        yield flush()

    counted = rows.select("text", "toxic").mapInArrow(run, "unit string, n long, n_toxic long")
    return counted.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def learn_lexicon(rows: DataFrame, folder: Work) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings far more frequent in toxic texts, with weights from 0 to 1."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return {}, {}
    base = total.t / total.n
    precision = F.col("n_toxic") / F.col("n")
    clean = F.col("n") - F.col("n_toxic")
    ratio = F.col("n_toxic") * F.log(precision / base) + F.when(
        clean > 0, clean * F.log(clean / F.col("n") / (1 - base))
    ).otherwise(0.0)
    known = _units(rows).where((precision >= PRECISION) & (2 * ratio >= EVIDENCE)).select("unit", precision.alias("p"))
    known = folder.save(known, "lexicon")
    size = known.agg(F.sum(F.octet_length("unit") + 100)).first()[0] or 0
    if size > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {size} bytes is too large to broadcast; fit on fewer rows")
    found = known.collect()
    words = {r.unit: float(r.p) for r in found if not r.unit.endswith("*")}
    stems = {r.unit[:-1]: float(r.p) for r in found if r.unit.endswith("*")}
    return words, stems


def _featured(rows: DataFrame, keep: Sequence[str], text: str, words: dict, stems: dict) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast((words, stems))

    def start():
        lexicon, machine = Lexicon(*known.value), grammar()
        return lambda texts: [[features(t, lexicon, machine) for t in texts]]

    return annotate(rows, keep, text, "__features array<double>", start)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Lexicon and regression from labelled rows that are not held out."""
    spark = docs.sparkSession
    with work(spark, "toxicity") as folder:
        training = folder.save(training_rows(docs, labels, id, text, rows), "training")
        words, stems = learn_lexicon(training, folder)
        if training.select("toxic").distinct().count() < 2:
            return Model(words, stems, *UNTRAINED)
        ready = _featured(training, ["toxic"], "text", words, stems).select(
            array_to_vector("__features").alias("features"), F.col("toxic").cast("double").alias("label")
        )
        ready = folder.save(ready, "features")
        fitted = LogisticRegression(maxIter=50, regParam=1e-4).fit(ready)
        return Model(words, stems, tuple(float(w) for w in fitted.coefficients), float(fitted.intercept))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, ``held_out``, ``score`` from 0 to 1 and ``predicted`` of each row.

    Only the text enters the score. A null or empty text has no clauses and
    gets the score of a text without any. Rows stay as many as they are, with
    null ids (not held out) and repeats; an empty table gives none.
    """
    logit = F.lit(model.intercept)
    for i, weight in enumerate(model.weights):
        logit = logit + F.col("__features")[i] * F.lit(weight)
    scored = _featured(docs, [id], text, model.words, model.stems).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(
        id, held_out(id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
