"""URL filters: fixed host and path rules, and rules mined from labels by pattern growth.

A url is a set of tokens: host labels, the host's endings, path parts and query keys, with numbers folded. Pattern
growth over labelled urls (that of FP-growth, level by level in DataFrame operations) finds token combinations; those that imply
the bad label with enough confidence and support become block rules, longer ones that a shorter one covers are dropped. Each mined rule is posted under its rarest token, so a url meets only rules
of its own tokens; the rest of the rule is then compared.

Spark ML's FPGrowth isn't used for it: it lists every frequent combination, 2^n for n tokens that go together, and gives them
up only by a cut of the urls or of the combinations' length.

Defined results: host and path of a null url, or of one without ``://``, are empty and it is allowed; a url that no rule
fits is allowed; repeated rows and null ids are kept; without labelled urls nothing is mined; a very long url is one row of
tokens, all of them used; an empty table of pages gives no rows; extra columns are kept, those named like an output (host, path,
rule, verdict, mined) are replaced. Ids of pages and labels are compared as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.llm.names import free_prefix, others
from docpipe.llm.storage import shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``where`` is a host and a path, like ``example.com/en/``; it fits the host and all below it, and paths that start so."""

    where: str
    verdict: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"\A(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"\A(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of the longest fixed rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.where), r.where)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.where).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    fold = lambda x: F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(F.regexp_replace(x, r"\d+", "#"))
    parts = F.filter(F.split(F.translate(path, UPPER, LOWER), "[/._-]"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(parts, lambda x: F.concat(F.lit("p:"), fold(x))), F.transform(keys, lambda x: F.concat(F.lit("q:"), x))))


def mine(labelled: DataFrame, min_count: int = 20, min_confidence: float = 0.8, min_lift: float = 2.0) -> DataFrame:
    """Block rules (rule_no, tokens, confidence, hits) from (tokens, bad): all rows, all tokens, combinations of any length.

    Equal rows are counted first. A combination is the tokens in order of their number of urls, rarest first, and grows by
    commoner ones within the rows that hold it, as FP-growth does in its conditional bases. Three kinds are left out, none of
    which can be part of a needed rule: those of fewer than ``min_count`` bad rows, those with a shorter rule in them, and those
    that hold in the same rows as one of their parts, which would be the shorter rule.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule_no long, tokens array<string>, confidence double, hits double")
    rows = labelled.where(F.size("tokens") > 0)
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    rows = written(rows.groupBy(F.array_sort(F.array_distinct("tokens")).alias("tokens")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b")), "urls-sets")
    n, b = rows.agg(*sums).first()
    if not b:
        return none
    confidence = F.col("b") / F.col("n")
    rule = (confidence >= min_confidence) & (confidence / F.lit(b / n) >= min_lift)

    def counted(held: DataFrame) -> DataFrame:
        return held.groupBy("combo").agg(*sums)

    singles = rows.select("n", "b", F.explode("tokens").alias("token")).groupBy("token").agg(*sums).where(F.col("b") >= min_count)
    singles = written(singles.select(F.array(F.struct("n", "token")).alias("combo"), "token", "n", "b", rule.alias("rule")), "urls-tokens")
    found = [singles.where("rule").select("combo", "n", "b")]
    frontier = singles.where(~F.col("rule")).select("combo", "n", "b")
    # The other tokens of each row; rows of which equal ones are left are counted together.
    left = rows.select("tokens", F.col("n").alias("rows"), F.col("b").alias("bad"), F.explode("tokens").alias("token"))
    left = left.join(singles.where(~F.col("rule")).select("token", F.get("combo", F.lit(0)).alias("item")), "token")
    left = left.groupBy("tokens").agg(F.first("rows").alias("n"), F.first("bad").alias("b"), F.array_sort(F.collect_list("item")).alias("items"))
    left = written(left.groupBy("items").agg(*sums), "urls-left")
    held = left.select("items", "n", "b", F.explode(F.transform("items", lambda x: F.array(x))).alias("combo"))
    while frontier.limit(1).count():
        grown = held.withColumn("more", F.explode(F.filter("items", lambda x: x > F.element_at("combo", -1))))
        grown = grown.select("items", "n", "b", F.concat("combo", F.array("more")).alias("combo"))
        often = counted(grown.where("b > 0")).where(F.col("b") >= min_count).select("combo")
        # Every part with one token less has to be in the frontier, and in more rows.
        parts = often.select("combo", F.explode(F.transform("combo", lambda x: F.array_remove("combo", x))).alias("part"))
        parts = parts.join(frontier.select(F.col("combo").alias("part"), F.col("n").alias("of_part")), "part").groupBy("combo").agg(F.count(F.lit(1)).alias("parts"), F.min("of_part").alias("least"))
        parts = parts.where(F.col("parts") == F.size("combo")).drop("parts")
        level = written(counted(grown.join(parts.select("combo"), "combo", "left_semi")).join(parts, "combo").where(F.col("n") < F.col("least")).drop("least").withColumn("rule", rule), "urls-level")
        found.append(level.where("rule").select("combo", "n", "b"))
        frontier = level.where(~F.col("rule")).drop("rule")
        held = written(grown.join(frontier.select("combo"), "combo", "left_semi").select("items", "n", "b", "combo"), "urls-held")
    kept = reduce(DataFrame.unionAll, found).select(F.sort_array(F.col("combo.token")).alias("tokens"), confidence.alias("confidence"), F.col("b").cast("double").alias("hits"))
    return kept.select(F.xxhash64("tokens").alias("rule_no"), "tokens", "confidence", "hits")


def blocked(urls: DataFrame, rules: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Keys of ``urls`` (key, tokens) that a mined rule fits."""
    rarest = rules.select("rule_no", F.col("tokens").alias("rule_tokens"), F.explode("tokens").alias("token")).join(frequencies, "token", "left")
    index = rarest.groupBy("rule_no", "rule_tokens").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    posted = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    return posted.join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], page_id: str = "page_id", label_id: str = "doc_id", **limits) -> DataFrame:
    """Add host, path, rule and verdict to each page; columns of these names are replaced."""
    kept = others(pages.columns, ("host", "path", "rule", "verdict", "mined"))
    p = free_prefix(pages.columns)
    shared_dir(pages.sparkSession)
    url = F.col("url")
    pages = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = tokens_of(url, F.col("host"), F.col("path"))
    bad = labels.select(F.col(f"`{label_id}`").alias("_label"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where(F.col("bad").isNotNull())
    labelled = pages.select(F.col(f"`{page_id}`").alias("_label"), tokens.alias("tokens")).join(bad, "_label").select("tokens", "bad").checkpoint()
    mined = mine(labelled, **limits).checkpoint()
    fixed = rule_for(F.col("host"), F.col("path"), rules)
    if not mined.limit(1).count():
        judged = pages.withColumn("mined", F.lit(False))
    else:
        frequencies = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().withColumnRenamed("count", "n")
        urls = pages.select(F.xxhash64(F.coalesce(url, F.lit(""))).alias("key"), tokens.alias("tokens")).dropDuplicates(["key"])
        hit = blocked(urls, mined, frequencies).select(F.col("key").alias(f"{p}key"), F.lit(True).alias("mined"))
        judged = pages.withColumn(f"{p}key", F.xxhash64(F.coalesce(url, F.lit("")))).join(hit, f"{p}key", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    found = judged.withColumn(f"{p}fixed", fixed)
    verdict = F.coalesce(F.col(f"{p}fixed.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return found.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{p}fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")
