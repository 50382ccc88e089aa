"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are put in one global order, rare ones first. If two
documents are similar enough, their smallest common shingles stand in the
prefixes of both: for every ``l``, prefixes of length ``n - required + l`` share
at least ``l`` shingles. A longer prefix costs more index rows but lets fewer
pairs through, so each document takes the ``l`` for which index rows and
estimated candidates together cost least, and a pair must share as many prefix
shingles as the smaller ``l`` of the two demands before it is verified.

Equal sets are folded first. Large groups of near copies are folded next: each
document is compared with the most central document that shares enough prefix
shingles with it, and the shingles in which the two differ are kept. Two
documents of the same centre differ at most in both their differences together,
so they link if these are few enough; all that link for this reason link with
the one that differs least. Others can link only if their differences, which are
small and mostly rare shingles, overlap much, which a prefix join over them
finds without pairing the group. Pairs of different centres meet by their prefix
shingles. What is connected already needs no test; all else that shares enough
is verified on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trellium.functions.rows import row_pick, unpack
from trellium.llm.components import components, label_nodes
from trellium.llm.tables import sum_tables
from trellium.llm.texts import annotate, fresh
from trellium.llm.work import Work, lasting, work

# Words whose hashes are remembered per task.
MEMORY_WORDS = 300_000

# Document frequencies are estimated in a table of SKETCH_ROWS rows of counters, as many in
# a row as there are documents, rounded up to a power of two between the two limits.
SKETCH_ROWS = 2
SKETCH_LEAST, SKETCH_MOST = 18, 24
# An estimate counts if it is so many standard deviations above the noise of other shingles.
SKETCH_NOISE = 6.0

# Cost of a candidate relative to an index row, and other documents that a rare shingle is expected in.
CANDIDATE_COST = 4.0
RARE_OTHERS = 0.1
MOST_MATCHES = 8
# Differences that two documents of a centre must share among the first ones, if they must share so many.
FAMILY_MATCHES = 3

# Buckets of document ids by which texts are picked out before the exact join; bounds what is broadcast.
PICK_BUCKETS = 1 << 18
# Rows of one shingle or digest that stay together in a join; a hotter one is dealt into shares.
SHARE_ROWS = 500_000


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; two sets link if 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    def required(self, n):
        """Shingles that a partner of a set of ``n`` must share at least."""
        return -(-n * self.percent // 100)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = value
        return value


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(31)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # Of bytes, split() takes the blanks 20 and 09 to 0D, and lower() only A-Z.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(words))
        count = len(words) - size + 1
        mixed = hashes[:count] + np.uint64(size)
        for k in range(1, size):
            mixed = mixed * _MULTIPLY
            mixed ^= mixed >> _SHIFT
            mixed += hashes[k : k + count]
        mixed = mixed * _FINISH
        mixed ^= mixed >> _SHIFT
        return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cells(shingles: np.ndarray, width: int) -> list[np.ndarray]:
    """Counter of each shingle in each row of the sketch."""
    mask = np.uint64(width - 1)
    return [(shingles >> np.uint64(24 * r)) & mask for r in range(SKETCH_ROWS)]


@dataclass
class Sketch:
    """Estimated document frequencies of shingles."""

    counts: list[np.ndarray]

    def __post_init__(self):
        self.means = [float(c.mean()) for c in self.counts]
        self.floor = SKETCH_NOISE * max(m**0.5 for m in self.means) + 8

    def others(self, shingles: np.ndarray) -> np.ndarray:
        """Other documents with the shingle, 0 where the estimate doesn't stand out."""
        width = len(self.counts[0])
        found = [c[i] - m for c, m, i in zip(self.counts, self.means, _cells(shingles, width))]
        least = np.minimum.reduce(found)
        return np.where(least >= self.floor, least, 0.0)


def build_sketch(docs: DataFrame, text: str, like: Likeness) -> Sketch:
    """Counters over all documents."""
    width = 1 << min(SKETCH_MOST, max(SKETCH_LEAST, (max(docs.count(), 1) - 1).bit_length()))

    def start():
        shingler = Shingler(like.words)

        def add(texts, table):
            found = np.concatenate([shingler(t) for t in texts])
            for r, cells in enumerate(_cells(found, width)):
                np.add.at(table[r * width : (r + 1) * width], cells, 1)

        return add

    table = sum_tables(docs, text, SKETCH_ROWS * width, start)
    return Sketch([row.astype(np.float32) for row in table.reshape(SKETCH_ROWS, width)])


def order_shingles(shingles: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as numbers in the global order, smallest first, and their ``others``.

    The first 6 bits are the frequency class, the rest is the hash.
    """
    level = np.zeros(len(shingles), np.uint64)
    frequent = others > 0
    level[frequent] = np.minimum(61, 1 + np.log2(others[frequent])).astype(np.uint64)
    # One bit stays free, so that the numbers are positive as signed ones too.
    numbers = (level << np.uint64(57)) | (shingles >> np.uint64(7))
    order = np.argsort(numbers, kind="stable")
    return numbers[order], others[order]


def choose_matches(n: int, required: int, others: np.ndarray) -> int:
    """The l whose prefix costs least: its index rows, and candidates, of which each shares l of its shingles."""
    most = min(MOST_MATCHES, required)
    costs = np.cumsum(np.where(others > 0, others, RARE_OTHERS))
    choices = [(n - required + m) + CANDIDATE_COST * costs[n - required + m - 1] / m for m in range(1, most + 1)]
    return 1 + int(np.argmin(choices))


def _describe(docs: DataFrame, sketch: Sketch, id: str, text: str, like: Likeness) -> DataFrame:
    """id, number of shingles, digest of the set, matches asked for, and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def start():
        shingler, known = Shingler(like.words), shared.value

        def one(value):
            found = shingler(value)
            n = len(found)
            if not n:
                return 0, None, 0, None
            numbers, others = order_shingles(found, known.others(found))
            required = like.required(n)
            matches = choose_matches(n, required, others)
            prefix = numbers[: n - required + matches].astype(np.int64)
            return n, xxhash.xxh3_128_digest(found.tobytes()), matches, prefix

        return lambda texts: list(zip(*map(one, texts))) or [[]] * 4

    return annotate(docs, [id], text, "n long, digest binary, matches int, prefix array<long>", start)


def _shares(rows: Column) -> Column:
    """Into how many shares the rows of a key are dealt."""
    return F.greatest(F.lit(1), F.ceil(rows / SHARE_ROWS)).cast("int")


def _dealt(rows: DataFrame, times: str) -> DataFrame:
    """Rows with a share of their key at random; ``times`` is how many rows the key has."""
    return rows.withColumn("share", F.floor(F.rand(11) * _shares(F.col(times))).cast("int"))


def _in_each_share(rows: DataFrame, times: str) -> DataFrame:
    """Rows once for each share of their key."""
    return rows.withColumn("share", F.explode(F.sequence(F.lit(0), _shares(F.col(times)) - 1)))


def _any_hot(postings: DataFrame) -> bool:
    return not postings.where(F.col("df") > SHARE_ROWS).isEmpty()


def _to_its_group(rows: DataFrame, keyed: DataFrame, key: str, times: str) -> DataFrame:
    """Rows joined to the one row of their key; ``keyed`` is a written table that counts them in ``times``.

    Keys of more than a share of rows are few, at most one per ``SHARE_ROWS`` rows,
    so their list is broadcast; without any, a plain join does.
    """
    hot = keyed.where(F.col(times) > SHARE_ROWS)
    if hot.isEmpty():
        return rows.join(keyed, key)
    listed = F.broadcast(hot.select(key, F.col(times).alias("hot")))
    dealt = _dealt(rows.join(listed, key, "left").withColumn("hot", F.coalesce("hot", F.lit(1))), "hot").drop("hot")
    return dealt.join(_in_each_share(keyed, times), [key, "share"]).drop("share")


def _postings(folder: Work, slim: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Prefix shingles found with two or more representatives: (token, doc, n, matches, level, df).

    ``level`` is the smallest l whose prefix holds the shingle.
    """
    chosen = slim.join(reps.select("digest", F.col("rep").alias("doc")), ["digest", "doc"], "left_semi")
    free = (F.col("n") - F.expr(f"(n * {like.percent} + 99) div 100")).cast("long")
    packed = F.shiftleft(F.col("n"), 8) + F.col("matches") * 16
    rows = chosen.select("doc", packed.alias("packed"), free.alias("free"), F.posexplode("prefix").alias("at", "token")).select(
        "token", "doc", (F.col("packed") + F.greatest(F.lit(1), F.col("at") - F.col("free") + 1)).alias("packed")
    )
    common = folder.save(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")
    postings = folder.save(
        _to_its_group(rows, common, "token", "df").select(
            "token", "doc", F.shiftright("packed", 8).alias("n"),
            (F.shiftright("packed", 4) % 16).cast("int").alias("matches"), (F.col("packed") % 16).cast("int").alias("level"), "df",
        ),
        "postings",
    )
    folder.drop("common")
    return postings


def _pick_texts(folder: Work, docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, text) of the wanted documents; one row per id."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(PICK_BUCKETS)).cast("int")
    buckets = wanted.select(bucket("doc").alias("bucket")).distinct()  # at most PICK_BUCKETS rows
    some = docs.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    near = some.withColumn("bucket", bucket("doc")).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")
    return folder.save(near.join(wanted, "doc", "left_semi"), "texts")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    # A central document of many pairs is a; its rows may be split, as each pair stands alone.
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def _compare(folder: Work, pairs: DataFrame, texts: DataFrame, like: Likeness, name: str, differences: bool = False) -> DataFrame:
    """Pairs (a, b) whose whole texts link; with ``differences`` also close ones, and how b differs from a.

    Added shingles come before missing ones, each by hash: one order for all b of an a.
    """
    joined = _with_texts(pairs, texts)
    ids = [joined.schema["a"], joined.schema["b"]]
    least = 2 * like.percent - 100 if differences else like.percent
    more = T._parse_datatype_string("linked boolean, n long, differing long, diff array<long>").fields if differences else []
    out = T.StructType([*ids, *more])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(like.words)
        arrow = to_arrow_schema(out)
        last, last_set = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                passed, rows = [], []
                for one, two in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if one != last:
                        last, last_set = one, shingler(one)
                    other = shingler(two)
                    near = similar(last_set, other, least)
                    passed.append(near)
                    if near and differences:
                        diff = np.concatenate([
                            np.setdiff1d(other, last_set, assume_unique=True), np.setdiff1d(last_set, other, assume_unique=True)
                        ])
                        rows.append((similar(last_set, other, like.percent), len(other), len(diff), diff.view(np.int64)))
                kept = [part.column(i).filter(pa.array(passed, pa.bool_())) for i in (0, 1)]
                if differences:
                    kept += [pa.array(v, type=arrow.field(2 + i).type) for i, v in enumerate(list(zip(*rows)) or [[]] * 4)]
                yield pa.RecordBatch.from_arrays(kept, schema=arrow)

    return folder.save(joined.mapInArrow(run, out), name)


def _central_pairs(postings: DataFrame, like: Likeness) -> DataFrame:
    """For each document b the central one, a, that shares most prefix shingles with it, as many as it must.

    Central is a document whose prefix shingles are common: copies lie around
    it. One is chosen per shingle by an aggregate, so a shingle in a third of
    all documents is folded on the map side.
    """
    weight = postings.groupBy("doc").agg((F.sum(F.log2("df")) / F.max("n")).alias("weight"))
    rows = postings.join(weight, "doc")
    best = rows.groupBy("token").agg(F.max(F.struct("weight", "doc", "n", "matches", "level")).alias("c"), F.max("df").alias("times"))
    if _any_hot(postings):
        met = _dealt(rows, "df").join(_in_each_share(best, "times"), ["token", "share"])
    else:
        met = rows.join(best, "token")
    met = met.where((F.col("doc") != F.col("c.doc")) & _may_link(like, "", "c."))
    shared = met.groupBy(F.col("doc").alias("b"), F.col("c.doc").alias("a")).agg(
        F.count("*").alias("shared"), F.first(F.least("matches", "c.matches")).alias("needed")
    ).where("shared >= needed")
    return shared.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def _slack(like: Likeness) -> Column:
    """Of a document of a centre: two of them link for sure if their slacks together are not negative."""
    return (100 - like.percent) * F.col("n") - (100 + like.percent) * F.col("differing")


def _least_differing(families: DataFrame, like: Likeness) -> DataFrame:
    """Per centre the document that differs least from it: (a, most, m)."""
    return families.groupBy("a").agg(F.max(F.struct(_slack(like).alias("slack"), "b")).alias("top")).select(
        "a", F.col("top.slack").alias("most"), F.col("top.b").alias("m")
    )


def _family_pairs(families: DataFrame, labels: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of one centre, not connected, whose differences may overlap as much as they must.

    To differ in at most k shingles, two documents with d and e differences from
    their centre must share (d + e - k) / 2 of them, so they share l of them among
    all but the last needed - l of either that others have too.
    """
    p = like.percent
    rows = label_nodes(families.withColumnRenamed("b", "doc"), labels, "doc").join(_least_differing(families, like), "a")
    rows = rows.select(
        "a", "doc", "label", "n", "differing", (_slack(like) + F.col("most") < 0).alias("far"), F.explode("diff").alias("token")
    )
    # Differences that no other component has add nothing to an overlap; the others count, rarest first.
    open_tokens = rows.groupBy("a", "token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("far").alias("any_far"), F.count("*").alias("times")
    ).where("low <> high and any_far").select("a", "token", "times")
    of_document = Window.partitionBy("a", "doc")
    rows = rows.join(open_tokens, ["a", "token"]).withColumns({
        "at": F.row_number().over(of_document.orderBy("times", "token")) - 1, "usable": F.count("*").over(of_document)
    })
    x, y = _in_each_share(rows.where("far"), "times").alias("x"), _dealt(rows, "times").alias("y")
    both = F.col("x.differing") + F.col("y.differing")
    allowed = F.floor((100 - p) * (F.col("x.n") + F.col("y.n")) / (100 + p))
    needed = F.greatest(F.lit(1), F.ceil((both - allowed) / 2))
    asked = F.least(needed, F.lit(FAMILY_MATCHES))
    met = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.share") == F.col("y.share"))).where(
        (F.col("x.label") != F.col("y.label")) & (~F.col("y.far") | (F.col("x.doc") < F.col("y.doc")))
        & (F.col("x.at") < F.col("x.usable") - needed + asked) & (F.col("y.at") < F.col("y.usable") - needed + asked)
        & (F.least("x.at", "y.at") + F.least(F.col("x.usable") - F.col("x.at"), F.col("y.usable") - F.col("y.at")) >= needed)
    )
    return (
        met.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        .agg(F.count("*").alias("shared"), F.first(asked).alias("asked")).where("shared >= asked").select("a", "b")
    )


def _may_link(like: Likeness, one: str, other: str) -> Column:
    """Whether two rows of a shingle fit in length and both hold it in the shorter prefix that they agree on."""
    pair = lambda name: (f"{one}{name}", f"{other}{name}")
    return (100 * F.least(*pair("n")) >= like.percent * F.greatest(*pair("n"))) & (
        F.greatest(*pair("level")) <= F.least(*pair("matches"))
    )


def _open_pairs(postings: DataFrame, families: DataFrame, labels: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of different centres that aren't connected, fit in length and share as many prefix shingles as they must.

    Of each shingle's documents, those of the centre (or component) that has
    most of them are not paired among themselves. A centre without one of its
    own is of its own family, as all others of it were compared with it.
    """
    centre = families.select(F.col("b").alias("doc"), F.col("a").alias("centre"))
    roots = families.select(F.col("a").alias("doc")).distinct().join(centre, "doc", "left_anti")
    centre = centre.union(roots.select("doc", F.col("doc").alias("centre")))
    rows = label_nodes(postings, labels, "doc").join(centre, "doc", "left")
    # A centre and a label may be the same number and are different groups.
    group = lambda central, value: F.struct(F.lit(central).alias("central"), F.col(value).alias("id"))
    rows = rows.withColumn("group", F.when(F.col("centre").isNotNull(), group(True, "centre")).otherwise(group(False, "label")))
    sizes = rows.groupBy("token", "group").agg(F.count("*").alias("size"))
    split = sizes.groupBy("token").agg(F.max(F.struct("size", "group")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    rows = rows.join(split.select("token", F.col("top.group").alias("main")), "token")
    x, y, keys = rows.where("group <> main"), rows, ["token"]
    if _any_hot(postings):  # else the rows lie by token already, and shares would move them once more
        x, y, keys = _in_each_share(x, "df"), _dealt(y, "df"), ["token", "share"]
    x, y = x.alias("x"), y.alias("y")
    in_main = F.col("y.group") == F.col("y.main")
    met = x.join(y, keys).where(
        (in_main | (F.col("x.doc") < F.col("y.doc"))) & (F.col("x.label") != F.col("y.label"))
        & ~F.coalesce(F.col("x.centre") == F.col("y.centre"), F.lit(False)) & _may_link(like, "x.", "y.")
    )
    return (
        met.groupBy(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        .agg(F.count("*").alias("shared"), F.first(F.least("x.matches", "y.matches")).alias("needed"))
        .where("shared >= needed").select("a", "b")
    )


def link_documents(docs: DataFrame, like: Likeness = Likeness(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Words are runs without blanks, A-Z lower-cased. A text with fewer words than
    a shingle has is one shingle; a null text or one without words has none and
    links with nothing. The component is the smallest id reachable by links, at
    least the own one. Rows of equal id are one document. A row with a null id
    has no component and links with nothing. An empty table gives none. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    out = lasting(spark, "ngrams")
    with work(spark, "ngrams") as folder:
        slim = out.save(
            _describe(docs, build_sketch(docs, text, like), id, text, like).withColumnRenamed(id, "doc"), "documents"
        )
        known = slim.where(F.col("doc").isNotNull() & (F.col("n") > 0))
        reps = out.save(known.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "representatives")
        postings = _postings(folder, known, reps, like)
        texts = _pick_texts(folder, docs, postings.select("doc").distinct(), id, text)
        # An id with several texts ties their sets together.
        several = known.groupBy("doc").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
        links = folder.save(
            known.join(several.select("doc"), "doc", "left_semi").join(reps, "digest")
            .select(F.col("doc").alias("a"), F.col("rep").alias("b")),
            "links",
        )
        central = folder.save(_central_pairs(postings, like), "central")
        families = _compare(folder, central, texts, like, "families", differences=True)
        least = _least_differing(families, like)
        sure = families.join(least, "a").where((_slack(like) + F.col("most") >= 0) & (F.col("b") != F.col("m")))
        links = links.union(families.where("linked").select("a", "b")).union(sure.select(F.col("m").alias("a"), "b"))
        labels = components(links, folder, "first")
        pairs = _family_pairs(families, labels, like).union(_open_pairs(postings, families, labels, like)).distinct()
        links = links.union(_compare(folder, folder.save(pairs, "open"), texts, like, "linked"))
        labels = out.save(components(links, folder, "components"), "labels")
    rows = slim.select("doc", "n", "digest")
    of_group = F.col("doc").isNotNull() & (F.col("n") > 0)
    grouped = _to_its_group(rows.where(of_group), reps, "digest", "copies").select("doc", "n", "rep")
    member = grouped.union(rows.where(~of_group).select("doc", "n", F.col("doc").alias("rep")))
    return label_nodes(member, labels, "rep").select(
        F.col("doc").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.col("label")).alias("component_id"),
    )


def keep_one(docs: DataFrame, like: Likeness = Likeness(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, in all their columns: of each component the document with the smallest id.

    Documents without shingles and rows with a null id all stay; of several rows
    with one id the smallest stays. Only rows whose id shares a bucket with a
    dropped or repeated one are shuffled.
    """
    linked = link_documents(docs, like, id, text)
    known = linked.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc")).agg(
        F.count("*").alias("rows"), F.min("component_id").alias("component"), F.max("n_shingles").alias("n")
    )
    wanted = lasting(docs.sparkSession, "kept").save(
        known.withColumn("dropped", (F.col("component") != F.col("doc")) & (F.col("n") > 0))
        .where("dropped or rows > 1").select("doc", "dropped"),
        "decided",
    )
    bucket, dropped, row = (fresh(name, docs.columns) for name in ("bucket", "dropped", "row"))
    key = F.pmod(F.xxhash64(F.col(f"`{id}`")), F.lit(PICK_BUCKETS)).cast("int")
    buckets = wanted.select(F.pmod(F.xxhash64("doc"), F.lit(PICK_BUCKETS)).cast("int").alias(bucket)).distinct()
    small = F.broadcast(buckets)  # at most PICK_BUCKETS rows
    marked = docs.withColumn(bucket, F.when(F.col(f"`{id}`").isNotNull(), key))
    names = [F.col(f"`{c}`") for c in docs.columns]
    far = marked.join(small, bucket, "left_anti").select(names)
    near = marked.join(small, bucket, "left_semi").select(names)
    decided = near.join(wanted.select(F.col("doc").alias(id), F.col("dropped").alias(dropped)), id, "left")
    single = decided.where(F.col(dropped).isNull()).select(names)
    repeated = decided.where(~F.col(dropped)).select(names)
    one = repeated.groupBy(F.col(f"`{id}`").alias(fresh("key", docs.columns))).agg(row_pick(repeated, "min").alias(row))
    return far.union(single).union(one.select(*unpack(row, docs.columns)))
