"""Benchmark decontamination by latent semantic retrieval.

Passages become TF-IDF vectors over the benchmark's words, with document
frequencies over all documents. A randomised SVD of the passages of all documents
and items, whose products with the matrix are summed by Spark tasks, gives a latent
space. Items longer than a
window are cut into passages, and windows of each document are compared with
the passages by cosine there; what comes near is checked against the whole item
by the longest common subsequence of words, and where that leaves it open, by
whether the item's answer stands there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.tables import sum_tables
from trellium.llm.texts import annotate, keep_rows, slices
from trellium.llm.work import work

# A block of items that one pass over the documents searches for: its words and its distinct words, which
# bound the matrices and what is broadcast (about 512 bytes for each passage of 64 words and each distinct word).
BLOCK_WORDS = 1_000_000
BLOCK_TERMS = 60_000
# Words of documents whose sums are held at once, and cosines computed at once.
SPAN_WORDS = 32_768
CELLS = 4 << 20
# Numbers of the passage matrix that are multiplied with the basis at once.
ROW_CELLS = 4_096
RANK = 128
POWER_STEPS = 2
SEED = 7

# Windows of a document: words from one start to the next, and words in a window.
STEP = 16
SCALES = (32, 64)
# Scales of short passages, at most SHORT_PART of the window long; they are compared at these too.
SHORT_SCALES = (2, 4, 8, 16)
SHORT_PART = 0.75
# Cosine in latent space from which a window is a candidate for a passage.
NEAR = 0.5
# Terms that more than this share of documents has don't enter the vectors, unless a passage has
# fewer than LEAST_TERMS others. A candidate window has this share of the passage's weight at least.
COMMON_SHARE = 0.05
LEAST_TERMS = 8
LEAST_PART = 0.3

# Share of an item's words, in order, from which a document has it; with the answer from the lower one.
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8

# ASCII letters lower-cased; punctuation is a blank. Other bytes stay, so words of all scripts do.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_ANSWER = re.compile(r"(?is).*(?:answer|solution)\s*[:=]\s*(.+)$")
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*$")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def answer_of(text: str) -> list[bytes]:
    """Words after ``Answer:``, or else of the last sentence."""
    found = _ANSWER.match(text)
    if found:
        return words_of(found.group(1))
    last = _SENTENCE.search(text.rstrip())
    return words_of(last.group(0) if last else text)


class Pattern:
    """Longest common subsequence with a fixed list of words, or of their numbers, bit by bit over its words."""

    def __init__(self, words: list):
        self.size = len(words)
        self.places: dict = {}
        for i, word in enumerate(words):
            self.places[word] = self.places.get(word, 0) | 1 << i

    def limit(self, words: Iterable) -> int:
        """What ``common`` is at most: all places of the words that stand in ``words``, in any order."""
        places = self.places
        return sum([places[word].bit_count() for word in places.keys() & words])

    def common(self, words: list) -> int:
        everything = (1 << self.size) - 1
        state = everything
        get = self.places.get
        for word in words:
            at = get(word)
            if at:
                hit = state & at
                state = (state + hit | state - hit) & everything
        return self.size - state.bit_count()


def cut(words: list[bytes]) -> list[list[bytes]]:
    """Passages of nearly equal length, none longer than the largest window."""
    parts = -(-len(words) // max(SCALES))
    return [words[len(words) * k // parts : len(words) * (k + 1) // parts] for k in range(parts)]


@dataclass
class Item:
    id: object
    text: str
    words: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        self.words = words_of(self.text)
        self.answer = Pattern(answer_of(self.text))


@dataclass
class Sought:
    """An item as it is searched for, over the numbers of its words."""

    id: object
    pattern: Pattern
    answer: Pattern


def item_blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[Item]]:
    """Items with words, a block of bounded size at a time."""
    block, size, terms = [], 0, set()
    rows = benchmark.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")).where(F.col(text).isNotNull())
    for row in rows.distinct().orderBy(id, text).toLocalIterator():
        item = Item(row[0], row[1])
        if not item.words:
            continue
        if block and (size + len(item.words) > BLOCK_WORDS or len(terms.union(item.words)) > BLOCK_TERMS):
            yield block
            block, size, terms = [], 0, set()
        block.append(item)
        size += len(item.words)
        terms.update(item.words)
    if block:
        yield block


def document_counts(docs: DataFrame, text: str, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Documents, and how many of them have each term."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def start():
        ids = known.value
        present = set(ids)

        def add(texts, table):
            table[-1] += len(texts)
            found = [ids[w] for t in texts for w in present.intersection(words_of(t))]
            if found:
                table[:-1] += np.bincount(found, minlength=len(ids))

        return add

    table = sum_tables(docs, text, len(terms) + 1, start)
    return int(table[-1]), table[:-1]


def passage_rows(texts: list, terms: dict[bytes, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of the passages of some texts: where each row begins, and the terms and values of all.

    A passage without weight has no row.
    """
    size = max(SCALES)
    # Text by text: words are looked up while they are in the processor's cache.
    ids_of = [np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words)) for words in map(words_of, texts)]
    lengths = np.array(list(map(len, ids_of)), np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *ids_of])
    places = np.flatnonzero(ids >= 0)
    places = places[weights[ids[places]] > 0]
    of_text = np.searchsorted(np.cumsum(lengths), places, "right")
    parts = -(-lengths // size)
    passage = (np.cumsum(parts) - parts)[of_text] + (places - (np.cumsum(lengths) - lengths)[of_text]) // size
    keys, counts = np.unique(passage * len(terms) + ids[places], return_counts=True)
    row, at = np.divmod(keys, len(terms))
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    values = counts * weights[at]
    if len(begins):
        values /= np.repeat(np.sqrt(np.add.reduceat(values**2, begins)), np.diff(np.append(begins, len(at))))
    return begins, at, values


def _rows(texts: list, terms: dict[bytes, int], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same rows one by one."""
    begins, at, values = passage_rows(texts, terms, weights)
    for a, b in zip(begins, np.append(begins[1:], len(at))):
        yield at[a:b], values[a:b]


def _packed(begins: np.ndarray, at: np.ndarray, values: np.ndarray) -> bytes:
    return np.int64(len(begins)).tobytes() + begins.astype(np.int32).tobytes() + at.astype(np.int32).tobytes() + values.astype(np.float32).tobytes()


def _unpacked(part: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a part, so many at a time that their products with a basis stay small."""
    n = int(np.frombuffer(part, np.int64, 1)[0])
    begins = np.frombuffer(part, np.int32, n, 8)
    size = (len(part) - 8 - 4 * n) // 8
    at, values = np.frombuffer(part, np.int32, size, 8 + 4 * n), np.frombuffer(part, np.float32, size, 8 + 4 * (n + size))
    bounds = np.append(begins, size)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + ROW_CELLS, "right")) - 1)
        here = slice(bounds[first], bounds[last])
        yield bounds[first:last] - bounds[first], at[here], values[here]
        first = last


def passage_matrix(texts: DataFrame, terms: dict[bytes, int], weights: np.ndarray) -> DataFrame:
    """The passages of all texts as rows of a sparse matrix, one packed part per slice of texts."""
    known = texts.sparkSession.sparkContext.broadcast((terms, weights))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, idf = known.value
        for batch in batches:
            for part in slices(batch, 0):
                rows = passage_rows(part.column(0).to_pylist(), ids, idf)
                if len(rows[0]):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([_packed(*rows)], pa.binary())})

    return texts.mapInArrow(run, "part binary")


def randomised_svd(passages: DataFrame, terms: dict[bytes, int], weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passage matrix, by subspace iteration from random vectors.

    The matrix is made once from the texts and written. Each step is one job: tasks
    multiply their passages with the current basis, in single precision as the
    matrix is, and add up what comes back, a table of terms x rank numbers, in double.
    """
    with work(passages.sparkSession, "decontaminate") as folder:
        return _subspace(folder.save(passage_matrix(passages, terms, weights), "matrix"), len(terms), rank)


def run_sums(table: np.ndarray, rows: np.ndarray, begins: np.ndarray, sizes: np.ndarray, factors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each run, none empty, the sum of ``table``'s rows that its part of ``rows`` names, times their ``factors``.

    Longer runs come first; returned are their order and their sums. Whole rows are
    added: the first of every run, the second of those that have two, and so on.
    """
    order = np.argsort(-sizes, kind="stable")
    firsts, shorter = begins[order], -sizes[order]

    def taken(at: np.ndarray) -> np.ndarray:
        part = table[rows[at]]
        return part if factors is None else np.multiply(part, factors[at, None], out=part)

    sums = taken(firsts)
    for n in range(1, -int(shorter[0]) if len(shorter) else 0):
        longer = int(np.searchsorted(shorter, -n))
        sums[:longer] += taken(firsts[:longer] + n)
    return order, sums


def _subspace(matrix: DataFrame, size: int, rank: int) -> np.ndarray:
    rank = min(rank, size)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, rank)))[0]

    def product(basis: np.ndarray, numbers: int, small: bool) -> np.ndarray:
        known = matrix.sparkSession.sparkContext.broadcast(basis.astype(np.float32))

        def start():
            current = known.value

            def add(parts, table):
                whole = table.reshape(-1, rank)
                for begins, at, values in chain.from_iterable(map(_unpacked, parts)):
                    sizes = np.diff(np.append(begins, len(at)))
                    order, rows = run_sums(current, at, begins, sizes, values)
                    if small:
                        whole += rows.T @ rows
                        continue
                    # Back from passages to terms: each passage's number in ``rows``, and the cells term by term.
                    number = np.empty_like(order)
                    number[order] = np.arange(len(order))
                    by_term = np.argsort(at, kind="stable")
                    firsts = np.flatnonzero(np.diff(at[by_term], prepend=-1))
                    owner = np.repeat(number, sizes)[by_term]
                    order, sums = run_sums(rows, owner, firsts, np.diff(np.append(firsts, len(at))), values[by_term])
                    whole[at[by_term[firsts[order]]]] += sums

            return add

        return sum_tables(matrix, "part", numbers, start, np.float64).reshape(-1, rank)

    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(product(basis, size * rank, False))[0]
    _, turn = np.linalg.eigh(product(basis, rank * rank, True))
    return basis @ turn[:, ::-1]


@dataclass
class Index:
    """The passages of a block of items in latent space, by item and length.

    ``weights`` and ``latent`` end with a row for all other words.
    """

    items: list[Sought]
    item_of: np.ndarray
    passage_words: np.ndarray
    terms: dict[bytes, int]
    weights: np.ndarray
    latent: np.ndarray
    directions: np.ndarray
    passage_weights: np.ndarray

    def scales(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(words in a window, words between starts, passages) to be compared."""
        for scale in SHORT_SCALES:
            short = np.flatnonzero(self.passage_words <= SHORT_PART * scale)
            if len(short):
                yield scale, max(1, scale // 4), short
        for scale in SCALES:
            yield scale, STEP, np.arange(len(self.passage_words))

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.terms.get, words, repeat(len(self.terms))), np.int32, len(words))

    def near(self, texts_words: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) of windows that are candidates."""
        return self.near_ids([self.ids_of(words) for words in texts_words])

    def near_ids(self, texts_ids: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """The same from the numbers of the words, the texts laid end to end.

        ``SPAN_WORDS`` first words and the windows that begin there are looked at
        together. Their vectors are added up from known words only.
        """
        lengths = np.array(list(map(len, texts_ids)), np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        total = int(offsets[-1])
        ids = np.concatenate([np.zeros(0, np.int32), *texts_ids])
        longest = max(*SCALES, *SHORT_SCALES)
        scales = list(self.scales())
        for begin in range(0, total, SPAN_WORDS):
            here = ids[begin : begin + SPAN_WORDS + longest]
            places = begin + np.flatnonzero(self.weights[here] > 0)
            if not len(places):
                continue
            known = ids[places]
            weight = np.concatenate([[0.0], np.cumsum(self.weights[known])])
            first = int(np.searchsorted(offsets, begin, "right")) - 1
            last = int(np.searchsorted(offsets, min(total, begin + SPAN_WORDS), "left"))
            for scale, step, passages in scales:
                # Starts of each text's windows, from its first word on, that lie in this span.
                froms = [(k, a + max(0, -(-(begin - a) // step)) * step, min(b, begin + SPAN_WORDS)) for k, a, b in zip(range(first, last), offsets[first:], offsets[first + 1 :])]
                starts = np.concatenate([np.arange(a, b, step) for _, a, b in froms] or [np.zeros(0, np.int64)])
                owner = np.repeat([k for k, _, _ in froms], [max(0, -(-(b - a) // step)) for _, a, b in froms])
                if not len(starts):
                    continue
                ends = np.minimum(starts + scale, offsets[owner + 1])
                low, high = np.searchsorted(places, starts), np.searchsorted(places, ends)
                mass = weight[high] - weight[low]
                least = LEAST_PART * self.passage_weights[passages]
                directions = self.directions[passages].T
                chosen = np.flatnonzero((mass > 0) & (mass >= least.min()))
                rows = max(1, CELLS // len(passages))
                for at in range(0, len(chosen), rows):
                    some = chosen[at : at + rows]
                    order, sums = run_sums(self.latent, known, low[some], high[some] - low[some])
                    some = some[order]
                    norms = np.linalg.norm(sums, axis=1, keepdims=True)
                    sums /= np.where(norms > 0, norms, 1)
                    window, passage = np.nonzero(sums @ directions >= NEAR)
                    window = some[window]
                    heavy = mass[window] >= least[passage]
                    window, item = window[heavy], self.item_of[passages[passage[heavy]]]
                    for a in range(0, len(window), SPAN_WORDS):
                        w, i = window[a : a + SPAN_WORDS], item[a : a + SPAN_WORDS]
                        k = owner[w]
                        yield from zip(k.tolist(), i.tolist(), (starts[w] - offsets[k]).tolist(), (ends[w] - offsets[k]).tolist())

    def search(self, texts: list) -> list[list[dict]]:
        """Items found in each text, with the common words and how it was decided."""
        found, group, size = [], [], 0
        for words in map(words_of, texts):
            # Only the numbers are held: words that no item has don't matter.
            group.append(self.ids_of(words))
            size += len(words)
            if size >= SPAN_WORDS:
                found += self.search_ids(group)
                group, size = [], 0
        return found + self.search_ids(group)

    def search_ids(self, all_ids: list[np.ndarray]) -> list[list[dict]]:
        """The same for a group of texts."""
        found: list[dict[int, dict]] = [{} for _ in all_ids]
        seen: set[tuple[int, int, int, int]] = set()
        distinct: dict[int, set[int]] = {}
        enough: dict[tuple[int, int], bool] = {}
        for k, item, start, end in self.near_ids(all_ids):
            it = self.items[item]
            # Most candidates have too few of the item's words, in whatever order: the whole text first, then the region.
            if (k, item) not in enough:
                if k not in distinct:
                    distinct[k] = set(all_ids[k].tolist())
                enough[k, item] = it.pattern.limit(distinct[k]) / it.pattern.size >= PARAPHRASE
            if not enough[k, item]:
                continue
            best = found[k].get(item)
            # Several passages of an item come near one window.
            if best and best["common"] == it.pattern.size or (k, item, start, end) in seen:
                continue
            seen.add((k, item, start, end))
            region = all_ids[k][max(0, start - it.pattern.size) : end + it.pattern.size].tolist()
            if it.pattern.limit(region) / it.pattern.size < PARAPHRASE:
                continue
            common = it.pattern.common(region)
            if best and common <= best["common"]:
                continue
            ratio = common / it.pattern.size
            if ratio >= COPY:
                kind = "copy"
            elif ratio >= PARAPHRASE and it.answer.common(region) >= ANSWER * it.answer.size:
                kind = "paraphrase"
            else:
                continue
            found[k][item] = {"item": it.id, "common": common, "ratio": ratio, "kind": kind}
        return [[hits[i] for i in sorted(hits)] for hits in found]


def fit(docs: DataFrame, items: list[Item], text: str) -> Index:
    """Document counts and latent space over all documents; the items are passages of the space as well."""
    import pyarrow as pa

    spark = docs.sparkSession
    terms = {w: i for i, w in enumerate(sorted({w for item in items for w in item.words}))}
    n, counts = document_counts(docs, text, terms)
    idf = np.log((n + 1) / (counts + 1)) + 1
    used = counts <= COMMON_SHARE * n
    passages_of = [cut(item.words) for item in items]
    of_passage = [[terms[w] for w in words] for parts in passages_of for words in parts]
    for ids in map(set, of_passage):
        if sum(bool(used[i]) for i in ids) < LEAST_TERMS:
            used[sorted(ids, key=lambda i: counts[i])[:LEAST_TERMS]] = True
    weights = np.where(used, idf, 0.0)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    # As an Arrow table: rows of Python tuples are turned by Python workers of their own, beside those of the matrix.
    cut_texts = pa.table({"text": pa.array([b" ".join(words).decode() for parts in passages_of for words in parts], pa.string())})
    vectors = randomised_svd(spark.createDataFrame(cut_texts).unionByName(texts), terms, weights)
    # The last row stands for words that no item has.
    latent = np.vstack([weights[:, None] * vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    sums = np.stack([latent[ids].sum(axis=0) for ids in of_passage])
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    sought = [
        Sought(item.id, Pattern([terms[w] for w in item.words]), Pattern([terms.get(w, -1) for w in answer_of(item.text)])) for item in items
    ]
    return Index(
        sought, np.repeat(np.arange(len(items)), list(map(len, passages_of))), np.array(list(map(len, of_passage))), terms,
        np.append(weights, 0.0), latent, sums / np.where(norms > 0, norms, 1), np.array([weights[ids].sum() for ids in of_passage]),
    )


def _searcher(index):
    def start():
        return index.value.search

    return start


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item in it: id, item id, common_words, ratio, kind.

    ``kind`` is ``copy`` or ``paraphrase``. Null and empty texts and items hold
    nothing; repeated items are one, repeated documents are found each. An
    empty table on either side gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item].dataType.simpleString()
    result = None
    for items in item_blocks(benchmark, item, item_text):
        index = spark.sparkContext.broadcast(fit(docs, items, text))
        start = _searcher(index)
        hits = annotate(
            docs, [id], text, f"hits array<struct<item:{item_type},common:long,ratio:double,kind:string>>",
            lambda start=start: (lambda search: lambda texts: [search(texts)])(start()),
        ).where(F.size("hits") > 0)
        found = hits.select(id, F.explode("hits").alias("h")).select(
            id, F.col("h.item").alias(item), F.col("h.common").alias("common_words"), F.col("h.ratio").alias("ratio"),
            F.col("h.kind").alias("kind"),
        )
        result = found if result is None else result.unionByName(found)
    if result is None:
        id_type = docs.schema[id].dataType.simpleString()
        return spark.createDataFrame([], f"`{id}` {id_type}, `{item}` {item_type}, common_words long, ratio double, kind string")
    return result


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs``, whole and in all columns, that hold no benchmark item; nothing is shuffled."""
    spark = docs.sparkSession
    clean = docs
    for items in item_blocks(benchmark, item, item_text):
        index = spark.sparkContext.broadcast(fit(docs, items, text))
        start = _searcher(index)
        clean = keep_rows(clean, text, lambda start=start: (lambda search: lambda texts: [not h for h in search(texts)])(start()))
    return clean
