"""Secret scans: fixed signatures, and a guess-cost check of values in credential contexts.

A value after a word such as ``password=`` is a secret if guessing it is dear.
The cost is that of the cheapest way to put the value together from dictionary
words, dates, repeats, keyboard walks and brute-force characters, found by
dynamic programming over its positions. The dictionary holds the words that
guessers try first and, by their rank, the words that the corpus itself uses;
words beside it that read like words cost as much as a large word list, and
names of program parts and paths as much as one such word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.texts import annotate, fresh, made_of, slices
from trellium.llm.work import work

KINDS = ("assign", "access", "hex", "guess")

# Powers of ten of guesses from which a value counts as a secret.
SECRET_COST = 10.0


def _any_case(word: str) -> str:
    """Pattern for an ASCII word in either case; the IGNORECASE flag would take in other letters."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _words(*words: str) -> str:
    return "|".join(map(_any_case, words))


_LINK = r"[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = re.compile(rf"({_words('password', 'passwd', 'secret', 'token', 'api_?key')}){_LINK}([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_VALUE = r"([^\s\"'`,;<>()\[\]{}|]{4,})"
CONTEXTS = (
    re.compile(rf"(?:{_words('pwd', 'passphrase', 'passcode', 'private_?key', 'access_?key', 'credentials?', 'auth')}){_LINK}{_VALUE}"),
    re.compile(rf"(?:{_words('password', 'passwd', 'secret', 'token', 'api_?key')}){_LINK}{_VALUE}"),
    re.compile(rf"{_words('authorization')}{_LINK}(?:{_words('bearer', 'basic')})\x20+{_VALUE}"),
    re.compile(r"://[^\s:/@]+:([^\s:/@]{4,})@"),
)
# One of these stands, in lower case, in each match of ASSIGN or CONTEXTS.
ANCHORS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "@")

# Words that guessers try first, likeliest first.
COMMON = """
password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey
letmein shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman 1qaz2wsx 7777777 121212
000000 qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger
sunshine iloveyou 2000 charlie robert thomas hockey ranger daniel starwars klaster 112233 george computer michelle
jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom 777777 pass maggie 159753 aaaaaa ginger princess joshua
cheese amanda summer love ashley nicole chelsea matthew access yankees 987654321 dallas austin thunder taylor matrix
welcome admin root user guest login test demo example sample changeme default secret token api key value string null
none true false your here my new old the and for this that with from have server database service client system
winter spring autumn monday friday january december hello world house water green black white blue orange apple
correct horse battery staple money company office internet network private public account email phone
required optional missing invalid expired unknown forgotten protected encrypted provided disabled enabled redacted hidden
removed changed updated generated personal temporary permanent security authentication authorization authenticated
authorized unauthorized credentials certificate username address reference reminder recovery question answers sentence
document everything something anything nothing everyone someone another because through without between against
understanding knowledge information government business children different important following according possible
together sometimes although believe general special several section language meaning message chapter history science
ingredient weapon society service garden mission meeting agreement program project process problem product property
passage pattern current present against already however whether example contains includes available necessary
application environment variable parameter attribute configuration connection session request response provider
contraseña obligatorio información siempre también nosotros motdepasse obligatoire toujours information personne
passwort kennwort erforderlich benutzer vergessen sicherheit zwischen menschen deutsch
""".split()
LONGEST_WORD = 24
# A corpus word is one that makes up this share of all its words, so there are at most a million of them.
WORD_SHARE = 1e-6
WORD_TIMES = 5
# Words that a task counts before it sends them on.
HELD_WORDS = 50_000
LETTERS = re.compile(r"[^\W\d_]+")
# Power of ten of the words in a large list: the price of a word that isn't in the dictionary.
UNKNOWN_WORD = 6.0
WORDLIKE = re.compile(r"[a-zà-öø-ÿ]{3,16}|[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{2,15}|[A-Z]{3,16}")
# Parts of a program, an address or a path joined by marks that passwords of several words don't use.
NAME = re.compile(r"(?:[~.]{0,2}/)?[A-Za-z_]\w*(?:(?:\.|/|::|->)[A-Za-z_]\w*)+/?|[~.]{0,2}/[A-Za-z_]\w*/?", re.A)
# A name of several parts that is called or indexed.
CALLED = re.compile(r"[A-Za-z]+(?:[._][A-Za-z]+)+[(\[]")
CAMEL = re.compile(r"[A-Z]*[^\W\d_A-Z]+|[A-Z]+|[^\W\d_]+")
VOWELS = frozenset("aeiouyäöüàáâéèêëíîïóôúùûåæø")


class Dictionary:
    """Ranks of words, and the pairs of letters that words are made of."""

    def __init__(self, corpus: Iterable[str] = ()):
        self.ranks: dict[str, int] = {}
        for words in (COMMON, corpus):
            for rank, word in enumerate(words, start=1):
                self.ranks[word] = min(rank, self.ranks.get(word, rank))
        pairs = Counter(a + b for word in self.ranks if word.isalpha() for a, b in zip(word, word[1:]))
        least = sum(pairs.values()) / 2000
        self.pairs = frozenset(pair for pair, n in pairs.items() if n >= least)

    def reads_like_a_word(self, letters: str) -> bool:
        """In one case or capitalised, with vowels, and hardly a pair of letters that words don't have."""
        if not WORDLIKE.fullmatch(letters):
            return False
        low = letters.lower()
        vowels = sum(c in VOWELS for c in low)
        odd = sum(a + b not in self.pairs for a, b in zip(low, low[1:]))
        allowed = 1 if len(low) <= 5 else len(low) // (4 if vowels >= 0.45 * len(low) else 6)
        return 0.15 * len(low) <= vowels <= 0.8 * len(low) and odd <= allowed


LEET = str.maketrans("@4301!57$", "aaeoiists")

# Rows of a keyboard, and runs of the alphabet and of digits.
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm",
         "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {}
for _row in WALKS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
)
YEAR = re.compile(r"(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)

# Price of each character of a brute-force span of at most so many, which guessers try as they are; a
# longer span costs the alphabet of all its classes of characters, for each of its characters.
BRUTE_CHARACTER = 1.0
BRUTE_SHORT = 3
PART = 0.3
# Lower case, upper case, digits, all else: as bits, and the sizes of their alphabets.
CLASS_SIZES = {1: 26, 2: 26, 4: 10, 8: 33}
ALPHABETS = [math.log10(max(1, sum(n for bit, n in CLASS_SIZES.items() if classes & bit))) for classes in range(16)]


def _class(c: str) -> int:
    return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8


BUILT_IN = Dictionary()


def _word_parts(value: str, words: Dictionary) -> Iterator[tuple[int, int, float]]:
    lower = value.lower()
    if len(lower) != len(value):  # a letter whose lower case is longer
        lower = value
    ranks = words.ranks
    forms = [(lower, 0.0)]
    if (leet := lower.translate(LEET)) != lower:
        forms.append((leet, 0.6))
    for form, extra in forms:
        for start in range(len(form)):
            for end in range(start + 3, min(len(form), start + LONGEST_WORD) + 1):
                span = form[start:end]
                rank = ranks.get(span)
                turned = 0.3
                if rank is None:
                    rank = ranks.get(span[::-1])
                else:
                    turned = 0.0
                if rank is not None:
                    cased = 0.0 if value[start:end] == lower[start:end] else 0.5
                    yield start, end, math.log10(rank + 1) + extra + turned + cased


def _unknown_parts(value: str, words: Dictionary) -> Iterator[tuple[int, int, float]]:
    """Words beside the dictionary, and names all of whose parts are words or short."""
    for match in LETTERS.finditer(value):
        if words.reads_like_a_word(match.group()):
            yield match.start(), match.end(), UNKNOWN_WORD
    for match in NAME.finditer(value):
        parts = [p for q in LETTERS.findall(match.group()) for p in CAMEL.findall(q)]
        if all(len(p) <= 3 or p.lower() in words.ranks or words.reads_like_a_word(p) for p in parts):
            yield match.start(), match.end(), UNKNOWN_WORD


def _date_parts(value: str) -> Iterator[tuple[int, int, float]]:
    for match in DATE.finditer(value):
        yield match.start(), match.end(), math.log10(366 * 120)
    for match in YEAR.finditer(value):
        yield match.start(), match.end(), math.log10(120)


def _walk_parts(value: str) -> Iterator[tuple[int, int, float]]:
    lower = value.lower()
    start = 0
    while start < len(lower):
        end = start + 1
        while end < len(lower) and lower[end] in _NEXT.get(lower[end - 1], ()):
            end += 1
        if end - start >= 3:
            yield start, end, math.log10(47 * (end - start))
        start = max(end, start + 1)


def _repeat_parts(value: str, words: Dictionary) -> Iterator[tuple[int, int, float]]:
    for match in REPEAT.finditer(value):
        unit = match.group(1)
        times = (match.end() - match.start()) / len(unit)
        if match.end() - match.start() >= 3:
            yield match.start(), match.end(), guess_cost(unit, words, repeats=False) + math.log10(times)


def guess_cost(value: str, words: Dictionary = BUILT_IN, repeats: bool = True) -> float:
    """Power of ten of the guesses that the cheapest segmentation of the value takes.

    Time and memory grow in proportion to the value's length.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    found = [_word_parts(value, words), _unknown_parts(value, words), _date_parts(value), _walk_parts(value)]
    for parts in (*found, *([_repeat_parts(value, words)] if repeats else [])):
        for start, end, cost in parts:
            ending.setdefault(end, []).append((start, cost))
    best = [0.0] * (len(value) + 1)
    closed = [0.0] * (len(value) + 1)  # the best that doesn't end in a brute-force span, so that no span is cut in two
    spans = [math.inf] * len(ALPHABETS)  # the best that ends in a brute-force span within these classes
    for end in range(1, len(value) + 1):
        kind = _class(value[end - 1])
        for classes in range(1, len(spans)):
            within = min(spans[classes], closed[end - 1] + PART) + ALPHABETS[classes]
            spans[classes] = within if classes & kind else math.inf
        short = [closed[end - n] + PART + n * BRUTE_CHARACTER for n in range(1, min(BRUTE_SHORT, end) + 1)]
        closed[end] = min((best[start] + PART + cost for start, cost in ending.get(end, ())), default=math.inf)
        best[end] = min(closed[end], *spans, *short)
    return best[len(value)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed signatures: whole matches, leftmost and without overlap within a kind."""
    found = []
    lower = text.lower()
    if any(a in lower for a in ("pass", "secret", "token", "key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def credential_values(text: str) -> set[tuple[int, int]]:
    """Start and end of each value that stands in a credential context, prose too; ``guess_cost`` tells them apart."""
    lower = text.lower()
    if not any(a in lower for a in ANCHORS):
        return set()
    found = {m.span(2) for m in ASSIGN.finditer(text)}
    for context in CONTEXTS:
        found.update(m.span(1) for m in context.finditer(text))
    return {(start, end) for start, end in found if end - start >= 4 and not CALLED.match(text, start)}


def find_secrets(text: str, words: Dictionary = BUILT_IN) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start and then kind; code points, end exclusive."""
    spans = base_spans(text)
    spans += [("guess", a, b) for a, b in credential_values(text) if guess_cost(text[a:b], words) >= SECRET_COST]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, words: Dictionary = BUILT_IN, mask: str = "[secret]") -> str:
    """The text with each secret value masked.

    Keys and digits of fixed form go whole. Of an assignment only the value goes, and
    only if guessing it is dear: a signature alone takes in prose and code.
    """
    spans = []
    for kind, start, end in find_secrets(text, words):
        if kind == "assign":
            start, end = ASSIGN.match(text, start).span(2)
            if guess_cost(text[start:end], words) < SECRET_COST:
                continue
        spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def _spoken_words(text: str) -> set[str]:
    """Lower-case words of a text without the values in credential contexts."""
    values = sorted(credential_values(text))
    if values:
        parts, at = [], 0
        for start, end in values:
            parts.append(text[at : max(at, start)])
            at = max(at, end)
        text = " ".join([*parts, text[at:]])
    return {w for w in LETTERS.findall(text.lower()) if 3 <= len(w) <= LONGEST_WORD}


def corpus_words(docs: DataFrame, text: str = "text") -> list[str]:
    """Words of the corpus, most frequent first: those that stand in a millionth of all (text, word) pairs, and in five texts.

    By this share there are at most a million of them, at most 24 letters each, so
    that the list may go to the driver and to every task. Counts are folded in the
    tasks before they are shuffled. Equal texts in one slice count once.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for part in slices(batch, 0):
                for t in set(part.column(0).to_pylist()):
                    counts.update(_spoken_words(t or ""))
                    if len(counts) > HELD_WORDS:
                        yield flush()
        yield flush()

    folded = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "word string, n long")
    with work(docs.sparkSession, "words") as folder:
        counted = folder.save(folded.groupBy("word").agg(F.sum("n").alias("n")), "counts")
        total = counted.agg(F.sum("n")).first()[0] or 0
        common = counted.where((F.col("n") >= WORD_TIMES) & (F.col("n") >= WORD_SHARE * total))
        return [r.word for r in common.orderBy(F.desc("n"), "word").collect()]


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``spans``, an array of (kind, start, end), of each row.

    A null or empty text has no spans. Rows stay as many as they are, with null
    ids and repeats; an empty table gives none. Only counts of words are shuffled.
    """
    known = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, text))

    def start():
        words = made_of(known, Dictionary)
        return lambda texts: [[[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t or "", words)] for t in texts]]

    return annotate(docs, [id], text, "spans array<struct<kind:string,start:long,end:long>>", start)


def digest(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts per signature, the digest of the signatures' spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select(
        id,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` in all rows and columns, with secret values masked; ``n_chars`` follows where a text changed."""
    columns = docs.columns
    known = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, text))
    masked = fresh("masked", columns)

    def start():
        words = made_of(known, Dictionary)
        return lambda texts: [[redact(t, words) if t else t for t in texts]]

    done = annotate(docs, columns, text, f"{masked} string", start)
    changed = ~F.col(f"`{text}`").eqNullSafe(F.col(masked))
    made = {text: F.col(masked)}
    if "n_chars" in columns:
        made["n_chars"] = F.when(changed, F.length(masked)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in columns])
