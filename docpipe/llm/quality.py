"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text. The method's own rule looks across documents: normalised lines (lower case, single spaces) are
hashed, and for each host the distinct documents that hold a line are counted. Lines above the limit are removed, and a
document that loses most of its words this way is depleted and rejected.

Every text is read once: its figures and the hashes of its lines are written beside the row. Counting goes from the hashes: rows
of each line first, with partial sums, and exact distinct documents only for the few lines that enough rows hold. The lines that
go are few as well; up to ``few`` of them reach the rows as one array for each host, so that no text is shuffled, and beyond
that they are joined line by line.

Defined results: a null text counts as empty (no words, rejected by the base rules); a null host is a host of its own; empty
lines are never counted; rows of one id are one document, rows with a null id are one document for each text; repeated rows
get the same verdict; a very long text is one row like any other, its lines are an array in that row; an empty table gives no
rows; extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.llm.names import free_prefix, others
from docpipe.llm.storage import written

WHITE = r"[ \t-\r]+"
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", "kept")
_SALTS = 16


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def folded(text: Column) -> Column:
    """A text whose lines are in normal form (lower case, single spaces) once they are trimmed; the pattern is only run where there is something to fold."""
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])
    plain = F.when(other, F.translate(F.lower(text), "\t\x0b\x0c\r", "    ")).otherwise(F.lower(text))
    return let(plain, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))


def lines_of(text: Column) -> Column:
    """The lines of a text in normal form."""
    return F.transform(F.split(folded(text), "\n", -1), lambda x: F.trim(x))


def spaces_in(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def _again(found: Column) -> Column:
    """Of sorted structs (x, i) those whose x is found twice or more."""

    def again(e: Column, j: Column) -> Column:
        return ((j > 0) & (F.get(found, j - 1)["x"] == e["x"])) | F.coalesce(F.get(found, j + 1)["x"] == e["x"], F.lit(False))

    return F.filter(found, again)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more, each word once. Windows are compared by hash first, and those of equal hash by their words."""

    def covered(found: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def in_words(found: Column) -> Column:
        window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return let(F.sort_array(F.transform(found, lambda e: F.struct(window(e["i"]).alias("x"), e["i"].alias("i")))), lambda s: covered(_again(s)))

    def of_windows(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, _again), in_words))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, of_windows))


def base_metrics(text: Column) -> Column:
    """A struct of the figures of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).cast("long").alias("n_repeat_words"))

    return F.struct(
        let(words_of(text), of_words).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_min_docs: int = 20,
    line_max_share: float = 0.05,
    min_left_percent: int = 30,
    line_max_texts: int | None = 100,
    keep_text: bool = True,
    few: int = 4000,
) -> DataFrame:
    """Add figures and verdict to each document.

    A line is removed if more than ``line_min_docs`` and more than the share ``line_max_share`` of the host's distinct
    documents hold it, or if more than ``line_max_texts`` documents of different texts do, however large the host; a document is
    depleted if fewer than ``min_left_percent`` per cent of its words are left. ``removed_lines`` lists the positions of removed
    lines, from 0. Without ``keep_text`` the text is not among the columns.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in others(docs.columns, OUTPUTS)])
    p = free_prefix(docs.columns)
    stay = [c for c in docs.columns if keep_text or c != text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    of_text = F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))
    who = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("\x00"), of_text["a"].cast("string"), F.lit(" "), of_text["b"].cast("string")))
    keys = [F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00")).alias(f"{p}host"), who.alias(f"{p}who"), of_text.alias(f"{p}text")]
    hashed = lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("hash"), F.when(x != "", spaces_in(x) + 1).alias("words"))
    rows = written(docs.select(*[F.col(f"`{c}`") for c in stay], *keys, F.transform(lines_of(body), hashed).alias(f"{p}lines"), base_metrics(F.col(f"`{text}`")).alias(f"{p}m")), "quality-rows")
    frequent = written(_frequent(rows, p, line_min_docs, line_max_share, line_max_texts, 10 * few), "quality-frequent")

    gone = _marked_in_rows(rows, frequent, p) if frequent.count() <= few else _marked_by_join(rows, frequent, p)
    n_words, repeat = F.col(f"{p}m.w.n_words"), F.col(f"{p}m.w.n_repeat_words")
    removed = F.aggregate(f"{p}gone", F.lit(0).cast("long"), lambda acc, i: acc + F.get(F.col(f"{p}lines"), i)["words"])
    judged = gone.withColumn(f"{p}words", removed)
    failed = (n_words < min_words) | (repeat * 100 > n_words * max_repeat_percent)
    depleted = (n_words - F.col(f"{p}words")) * 100 < n_words * min_left_percent
    return judged.select(
        *[F.col(f"`{c}`") for c in stay],
        n_words.alias("n_words"),
        F.col(f"{p}m.word_chars").alias("word_chars"),
        F.col(f"{p}m.n_symbols").alias("n_symbols"),
        F.col(f"{p}m.n_dup_lines").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col(f"{p}gone").alias("removed_lines"),
        F.col(f"{p}words").alias("removed_words"),
        (~failed & ~depleted).alias("kept"),
    )


def _met(lines: DataFrame, some: DataFrame, on: list[str], spread: str, few: int) -> DataFrame:
    """The lines that are among ``some``: sent to all tasks if there are few. Otherwise both sides are dealt by a salt as well, as a line that a third of all documents hold would be one key."""
    if some.count() <= few:
        return lines.join(F.broadcast(some), on)
    salted = some.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return lines.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).join(salted.hint("merge"), [*on, "salt_"])


def _frequent(rows: DataFrame, p: str, min_docs: int, max_share: float, max_texts: int | None, few: int) -> DataFrame:
    """(host, hash) of the lines that go."""
    host, who, text, line = f"{p}host", f"{p}who", f"{p}text", f"{p}hash"
    held = rows.select(host, who, text, F.explode(F.array_distinct(F.col(f"{p}lines.hash"))).alias(line)).where(F.col(line).isNotNull())
    often = written(held.groupBy(host, line).agg(F.count(F.lit(1)).alias(f"{p}n")).where(F.col(f"{p}n") > (min_docs if max_texts is None else min(min_docs, max_texts))).drop(f"{p}n"), "quality-often")
    met = _met(held, often, [host, line], who, few)
    docs = met.groupBy(host, line).agg(F.countDistinct(who).alias(f"{p}docs"), F.countDistinct(text).alias(f"{p}texts"))
    hosts = rows.groupBy(host).agg(F.countDistinct(who).alias(f"{p}all"))
    goes = (F.col(f"{p}docs") > min_docs) & (F.col(f"{p}docs") > F.col(f"{p}all") * F.lit(max_share))
    if max_texts is not None:
        goes |= F.col(f"{p}texts") > max_texts
    return docs.join(hosts, host).where(goes).select(host, line)


def _marked_in_rows(rows: DataFrame, frequent: DataFrame, p: str) -> DataFrame:
    """Adds the positions of lines that go, with the few such lines of each host sent to all tasks."""
    listed = frequent.groupBy(f"{p}host").agg(F.collect_set(f"{p}hash").alias(f"{p}set"))
    joined = rows.join(F.broadcast(listed), f"{p}host", "left")
    hashes = F.col(f"{p}lines.hash")
    at = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.coalesce(F.array_contains(F.col(f"{p}set"), F.get(hashes, i)), F.lit(False)))
    none = F.array().cast("array<int>")
    return joined.withColumn(f"{p}gone", F.when(F.col(f"{p}set").isNull() | ~F.coalesce(F.arrays_overlap(hashes, f"{p}set"), F.lit(False)), none).otherwise(at)).drop(f"{p}set")


def _marked_by_join(rows: DataFrame, frequent: DataFrame, p: str) -> DataFrame:
    """The same by a join of lines, for any number of them. Rows of one document and equal lines have equal positions."""
    keys = [f"{p}host", f"{p}who", f"{p}key"]
    rows = rows.withColumn(f"{p}key", F.xxhash64(f"{p}lines.hash"))
    lines = rows.select(*keys, F.posexplode(f"{p}lines.hash").alias(f"{p}pos", f"{p}hash")).where(F.col(f"{p}hash").isNotNull())
    found = _met(lines, frequent, [f"{p}host", f"{p}hash"], f"{p}who", 0).groupBy(*keys).agg(F.sort_array(F.collect_set(f"{p}pos")).alias(f"{p}gone"))
    return rows.join(found, keys, "left").withColumn(f"{p}gone", F.coalesce(f"{p}gone", F.array().cast("array<int>"))).drop(f"{p}key")


def without_lines(text: Column, positions: Column) -> Column:
    """``text`` without the lines at these positions."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(positions) == 0, text).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(positions, i)), "\n"))


def cleaned(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that stay, with the removed lines gone and the columns of ``docs``."""
    judged = judge(docs, text, **limits).where("kept")
    return judged.select(*[without_lines(F.col(f"`{c}`"), F.col("removed_lines")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
