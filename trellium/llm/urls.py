"""URL filters: a rule list first, then association rules mined from labelled URLs.

All of it is DataFrame work. URLs become sets of tokens, FP-growth finds token
combinations that go with a label, rules of enough support and confidence stay
unless a part of them does as well, and an inverted index from each rule's
rarest token finds the rules of which a URL has every token. Tokens that stand
in the same labelled URLs are one item for FP-growth: a template of k tokens
would else give 2^k frequent combinations, all of one confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm.work import lasting, work
from trellium.operators.joins import join_hot

# Share of labelled URLs that have a combination; share of those with it that are labelled bad.
MIN_SUPPORT = 0.002
# Labelled URLs that must have a combination, however few there are in all.
MIN_ROWS = 10
MIN_CONFIDENCE = 0.6

BAD, GOOD = "label=bad", "label=good"


@dataclass(frozen=True)
class ListRule:
    """``host`` with all its subdomains, ``path`` as a beginning."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def list_verdict(host: Column, path: Column, rules: Sequence[ListRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host and its parts, path parts without numbers, names of query fields, fragment."""
    host, path = host_of(url), path_of(url)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda f: F.regexp_extract(f, r"^([^=]*)", 1))
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: F.regexp_replace(p, r"[0-9]+", "#"))
    return F.array_distinct(F.concat(
        tagged("scheme=", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        tagged("host=", F.array(host)),
        tagged("hostpart=", F.split(host, r"[.\-]")),
        tagged("path=", parts),
        tagged("field=", fields),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ))


def _classes(placed: DataFrame, rows: int, least: float, universal: bool) -> DataFrame:
    """(class, members): tokens of at least ``least`` rows, those of equal row sets together, named by their first.

    Row sets are compared by their size and two 64-bit sums of row hashes. As the
    members of a class stand in one URL, no class is larger than a URL's tokens.
    """
    hashes = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    counted = placed.groupBy("token").agg(F.count("*").alias("n"), *hashes).where(F.col("n") >= least)
    if not universal:
        counted = counted.where(F.col("n") < rows)
    members = counted.groupBy("n", "h1", "h2").agg(F.sort_array(F.collect_list("token")).alias("members"))
    return members.select(F.col("members")[0].alias("class"), "members")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule, antecedent, confidence, support) for bad URLs from rows (url, bad).

    The antecedent is a list of token lists: a URL matches with one token of each.
    The tokens of a list stood in the same labelled URLs. Null URLs and labels
    teach nothing; without labelled rows there are no rules. A rule goes if a
    part of its tokens is a rule of at least its confidence; so tokens of all
    labelled URLs are left out, unless they alone are a rule.
    """
    spark = labelled.sparkSession
    folder = lasting(spark, "url-rules")
    with work(spark, "urls") as scratch:
        known = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull())
        given = scratch.save(
            known.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), F.col("bad").cast("boolean").alias("bad")),
            "given",
        )
        totals = given.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
        rows = totals.n
        if not rows:
            return spark.createDataFrame([], "rule long, antecedent array<array<string>>, confidence double, support double")
        min_support = min(1.0, max(min_support, MIN_ROWS / rows))
        placed = given.select("row", F.explode("tokens").alias("token"))
        classes = scratch.save(_classes(placed, rows, min_support * rows, totals.bad >= min_confidence * rows), "classes")
        by_token = classes.select("class", F.explode("members").alias("token"))
        reduced = join_hot(placed, by_token, "token").groupBy("row").agg(F.collect_set("class").alias("items"))
        item = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
        baskets = scratch.save(
            given.join(reduced, "row", "left")
            .select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), item).alias("items")),
            "baskets",
        )
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        found = scratch.save(
            model.associationRules.where(F.col("consequent")[0] == BAD)
            .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
            .withColumn("rule", F.xxhash64("antecedent")),
            "found",
        )
        whole = found.select(
            "rule", F.col("antecedent").alias("all"), F.col("confidence").alias("own"), F.explode("antecedent").alias("token")
        )
        # Rules that hold all tokens of a smaller one.
        inside = join_hot(whole, _by_rarest(found, whole), "token").where(
            (F.size("antecedent") < F.size("all")) & (F.col("confidence") >= F.col("own")) & _within("antecedent", F.col("all"))
        ).select("rule").distinct()
        kept = found.join(inside, "rule", "left_anti")
        spelled = (
            kept.select("rule", "confidence", "support", F.explode("antecedent").alias("class")).join(classes, "class")
            .groupBy("rule", "confidence", "support").agg(F.sort_array(F.collect_list("members")).alias("antecedent"))
        )
        return folder.save(spelled.select("rule", "antecedent", "confidence", "support"), "rules")


def _by_rarest(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, antecedent, confidence): each rule at that of its tokens that fewest rows have."""
    counts = rows.groupBy("token").agg(F.count("*").alias("times"))
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)), "token"))["token"]
    return each.groupBy("antecedent", "confidence").agg(rarest.alias("token")).select("token", "antecedent", "confidence")


def _within(part: str, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def match(urls: DataFrame, rules: DataFrame, column: str = "url") -> DataFrame:
    """Distinct URLs that match a rule, with the largest confidence and the number of token combinations that match."""
    listed = urls.select(F.col(column).alias("url")).where(F.col("url").isNotNull()).distinct()
    first = rules.select(F.transform("antecedent", lambda c: c[0]).alias("antecedent"), "confidence")
    members = rules.select(F.explode("antecedent").alias("c")).select(F.explode("c").alias("word"), F.col("c")[0].alias("token")).distinct()
    words = listed.select("url", F.explode(tokens(F.col("url"))).alias("word"))
    # How many members of each class a URL has; a URL's classes are no more than its tokens.
    held = join_hot(words, members, "word").groupBy("url", "token").agg(F.count("*").alias("n")).groupBy("url").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("held")
    )
    rows = held.select("url", "held", F.explode(F.map_keys("held")).alias("token"))
    ways = F.aggregate("antecedent", F.lit(1).cast("long"), lambda n, c: n * F.element_at("held", c))
    return (
        join_hot(rows, _by_rarest(first, rows), "token").where(_within("antecedent", F.map_keys("held")))
        .groupBy("url").agg(F.max("confidence").alias("confidence"), F.sum(ways).alias("n_rules"))
    )


def judge(pages: DataFrame, rules: Sequence[ListRule], mined: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, confidence and n_rules of each row of ``pages``.

    The longest list rule decides; where none fits, a URL that matches a mined
    rule is blocked and any other allowed. A null URL has an empty host and
    path, matches nothing and is allowed. Rows stay as many as they are, with
    null ids and repeats; an empty table gives none.
    """
    at = F.col("address")
    plain = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("address"))
    plain = plain.select("*", F.coalesce(host_of(at), F.lit("")).alias("host"), F.coalesce(path_of(at), F.lit("")).alias("path"))
    rule, verdict = list_verdict(F.col("host"), F.col("path"), rules)
    found = match(plain, mined, "address").withColumnRenamed("url", "address")
    known = join_hot(plain.where(at.isNotNull()), found, "address", "left")
    unknown = plain.where(at.isNull()).withColumns({"confidence": F.lit(None).cast("double"), "n_rules": F.lit(None).cast("long")})
    return known.unionByName(unknown).select(
        F.col("id").alias(id), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "confidence", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
    )


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's label is the quality of the document whose id stands in its path."""
    number = F.expr("try_cast(__number as long)")
    linked = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/([0-9]+)", 1).alias("__number")).select(
        "url", number.alias("doc_id")
    )
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return linked.join(known, "doc_id").select("url", "bad")
