"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared in normal form: lower case, single spaces, and each character of a script without spaces as a word of its
own. A line goes if an earlier one (by document id, then text, then position) is equal, or is within the edit bound: one word
more, less or other for lines of ``min_edit_words`` or more, none for shorter ones.

Equal lines are found by hash. For the others each line has as its neighbourhood the line itself and all variants with one
word deleted; two lines within one edit share a variant. Emitting it for every line would be most of the work for nothing: one
edit leaves the first or the second half of the words intact, so a line whose halves (for its own length and for one word
less) no other line has can't be near any. Variants are emitted only for the other half of lines that share a half, as hashes
joined with that of the shared half. In a group of equal variants the earliest line stands against all others, so a group
gives as many pairs as it has lines; the edit distance of each pair is then verified on its words.

Defined results: a null text has one empty line and stays null; empty lines stay; rows of one id and equal text count as one
document and get the same result; null ids come first; different texts of one id rank by a hash of the text, then by position;
a very long text is one row like any other, and its lines are rows of their own; an empty table gives no rows; extra columns
are kept, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.llm.names import free_prefix, others
from docpipe.llm.quality import folded, let, spaces_in, without_lines
from docpipe.llm.scripts import UNSPACED
from docpipe.llm.storage import written

_SALTS = 8
_FEW_TEXTS = 1_000_000  # of which the 64-bit hashes may be sent to all tasks
_HALVES = ("k0", "k1", "k2", "k3")


def _text_keys(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]


def _apart(text: Column) -> Column:
    """The text with characters of scripts without spaces as words."""
    beyond = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{E00}-\x{10FFFF}]")  # one range is found fast
    return F.when(beyond, F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)


def _place(doc: Column, t1: Column, pos: Column) -> Column:
    """(doc, some bits of the text's hash, pos) as one number that orders like the three, null ids first."""
    whole = F.coalesce(doc.cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(10**18).cast("decimal(19,0)")
    return (whole + (t1.bitwiseAND(F.lit((1 << 27) - 1)) * (1 << 31) + pos).cast("decimal(18,0)")).cast("decimal(38,0)")


def _exploded(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    # Folded before they are exploded: what stands after would be repeated wherever a line is used.
    body = let(_apart(F.coalesce(F.col(f"`{text}`"), F.lit(""))), folded)
    lines = docs.select(*keep, F.posexplode(F.transform(F.split(body, "\n", -1), lambda x: F.trim(x))).alias("pos", "line"))
    return lines.where(F.col("line") != "")


def _features(docs: DataFrame, text: str, doc_id: str, min_edit_words: int) -> DataFrame:
    """Each line with its hashes, its number of words and the hashes of its halves.

    k0, k1: first n // 2 and last n - n // 2 words; k2, k3: the same cut for n - 1, with one word more in the middle left out.
    """
    found = _exploded(docs, text, F.col(f"`{doc_id}`").cast("long").alias("doc"), *_text_keys(F.col(f"`{text}`")))
    line = F.col("line")
    found = found.withColumn("n", spaces_in(line) + 1)

    def half(less: int, first: bool) -> Column:
        n = F.col("n") - less
        p = F.floor(n / 2).cast("int")
        part = F.call_function("substring_index", line, F.lit(" "), p if first else p - n)
        return F.when(n >= min_edit_words, F.xxhash64(n, F.lit(first), part))

    halves = [half(less, first).alias(k) for k, (less, first) in zip(_HALVES, ((0, True), (0, False), (1, True), (1, False)), strict=True)]
    return found.select("doc", "t1", "t2", "pos", _place(F.col("doc"), F.col("t1"), F.col("pos")).alias("at"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "n", *halves)


def _holding(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The texts whose hash t1 is among ``hashes``."""
    few = hashes.distinct()
    return texts.join(F.broadcast(few) if few.count() <= _FEW_TEXTS else few.hint("merge"), "t1", "left_semi")


def _variants(lines: DataFrame) -> DataFrame:
    """(at, kind, variant): kind 0 for one word other, 1 the shorter and 2 the longer of two lengths."""

    def of_half(x: Column, which: Column) -> Column:
        n = F.col("n") - F.when(which >= 2, F.lit(1)).otherwise(F.lit(0))
        p = F.floor(n / 2).cast("int")
        words, m = F.col("words"), F.col("n")
        rest = F.when(which % 2 == 0, F.slice(words, p + 1, m - p)).otherwise(F.slice(words, F.lit(1), m - (n - p)))

        def emitted(r: Column) -> Column:
            def without(i: Column) -> Column:
                return F.concat(F.slice(r, F.lit(1), i), F.slice(r, i + 2, F.size(r)))

            each = F.sequence(F.lit(0), F.size(r) - 1)
            same = F.transform(each, lambda i: F.struct(F.lit(0).alias("kind"), F.xxhash64(x, F.lit(0), i, without(i)).alias("variant")))
            longer = F.transform(each, lambda i: F.struct(F.lit(2).alias("kind"), F.xxhash64(x, F.lit(1), without(i)).alias("variant")))
            whole = F.array(F.struct(F.lit(1).alias("kind"), F.xxhash64(x, F.lit(1), r).alias("variant")))
            return F.when(which >= 2, longer).otherwise(F.concat(same, whole))

        return let(rest, emitted)

    halves = F.array(*[F.struct(F.col(k).alias("x"), F.lit(i).alias("i")) for i, k in enumerate(_HALVES)])
    shared = F.filter(halves, lambda e: F.coalesce(F.array_contains(F.col("shared"), e["x"]), F.lit(False)))
    every = F.flatten(F.transform(shared, lambda e: of_half(e["x"], e["i"])))
    return lines.select("at", F.explode(every).alias("v")).select("at", "v.kind", "v.variant")


def within_one_word(a: Column, b: Column) -> Column:
    """Whether word arrays are equal up to one word more, less or other."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False).cast("int")  # first difference, from 1; 0: none
    rest = lambda x, skip: F.slice(x, at + skip, F.size(x))
    return F.when(at == 0, True).when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1)).when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0)).when(F.size(b) == F.size(a) + 1, rest(b, 1) == rest(a, 0)).otherwise(False)


def _near(docs: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier one is near. groups: the distinct lines."""
    halves = groups.where(F.col("k0").isNotNull()).select("h1", "h2", F.explode(F.array(*_HALVES)).alias("half")).where(F.col("half").isNotNull())
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where(F.col("a") < F.col("b")).select("half")
    some = halves.join(shared, "half").groupBy("h1", "h2").agg(F.collect_set("half").alias("shared"))
    some = written(groups.join(some, ["h1", "h2"]).drop("copies"), "lines-shared")
    # Their words, from one text that holds each.
    holders = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("t1"))
    found = _exploded(_holding(holders, some.select("t1")).dropDuplicates(["t1"]), "text").select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "line").dropDuplicates(["h1", "h2"])
    lines = written(some.join(found, ["h1", "h2"]).withColumn("words", F.split("line", " ")).drop("line"), "lines-candidates")
    variants = written(_variants(lines), "lines-variants")
    side = F.when(F.col("kind") == 0, 0).otherwise(1).alias("side")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at"))).alias(f"first{kind}")
    leaders = variants.groupBy(side, "variant").agg(least(0), least(1), least(2), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).drop("rows")
    joined = variants.select("at", "kind", side, "variant").join(leaders, ["side", "variant"])
    leader = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = joined.select("at", leader.alias("leader")).where(F.col("leader") < F.col("at")).distinct()
    words = lines.select("at", "h1", "h2", "words")
    seen = pairs.join(words, "at").join(words.select(F.col("at").alias("leader"), F.col("words").alias("other")), "leader")
    return seen.where(within_one_word(F.col("words"), F.col("other"))).select("h1", "h2").distinct()


def find_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_edit_words: int = 5) -> DataFrame:
    """(doc, t1, t2, exact, near): for each document that loses lines, their positions by reason."""
    features = written(_features(docs, text, doc_id, min_edit_words), "lines-features")
    groups = features.groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), F.min("t1").alias("t1"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in _HALVES]
    )
    groups = written(groups, "lines-groups")
    near = written(_near(docs, groups, text), "lines-near").withColumn("is_near", F.lit(True))
    known = groups.select("h1", "h2", F.col("at").alias("first"), "copies").join(near, ["h1", "h2"], "left").where((F.col("copies") > 1) | F.col("is_near"))
    # One line may make up a third of all: both sides are dealt by a salt as well.
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).drop("copies")
    lines = features.select("doc", "t1", "t2", "pos", "at", "h1", "h2", F.pmod(F.col("t2"), F.lit(_SALTS)).cast("int").alias("salt"))
    hit = lines.join(known, ["h1", "h2", "salt"])
    later = F.col("at") != F.col("first")
    gone = hit.where(later | F.col("is_near"))
    return gone.groupBy("doc", "t1", "t2").agg(
        F.sort_array(F.collect_set(F.when(later, F.col("pos")))).alias("exact"),
        F.sort_array(F.collect_set(F.when(~later, F.col("pos")))).alias("near"),
    )


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """Add ``exact_lines`` and ``near_lines``, the positions (from 0) of lines that go, to each document."""
    kept = others(docs.columns, ("exact_lines", "near_lines"))
    p = free_prefix(docs.columns)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    found = find_duplicates(docs, text, doc_id, **limits)
    found = found.select(*[F.col(c).alias(p + c) for c in ("doc", "t1", "t2", "exact", "near")])
    keyed = docs.select("*", *[k.alias(f"{p}k{i}") for i, k in enumerate(_text_keys(F.col(f"`{text}`")))])
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(p + "doc")) & (F.col(p + "k0") == F.col(p + "t1")) & (F.col(p + "k1") == F.col(p + "t2"))
    joined = keyed.join(found, same, "left")
    none = F.array().cast("array<int>")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(p + "exact", none).alias("exact_lines"), F.coalesce(p + "near", none).alias("near_lines"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits) -> DataFrame:
    """The documents with the lines that go taken out of their texts; the columns of ``docs``."""
    marked = mark(docs, text, doc_id, **limits)
    return marked.select(*[without_lines(F.col(f"`{c}`"), F.concat("exact_lines", "near_lines")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
