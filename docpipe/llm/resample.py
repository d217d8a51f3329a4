"""Quality selection by importance resampling.

Two generative models of hashed n-grams (words and runs of signs, one and two in a row) are fitted: one on texts that labels
call good, one on all raw texts. A text's importance is the log ratio of its probability under the two. Gumbel noise, made
from a hash of id and text so that a run can be repeated, is added, and the k texts with the largest sums are the sample: this
draws k without replacement with weights that follow the importance. Importance adds up over a text, so its spread is hundreds of
times that of the noise: at the temperature of 1 the draw is all but the k most important texts, which keeps clean documents. A
higher ``temperature`` divides the importance and lets the noise bear on the draw; None takes the importance's standard deviation.

The raw model counts every text. The target model uses at most ``max_labelled`` good texts, chosen by hash. Both are vectors of
``buckets`` numbers, whatever the input.

Defined results: a null text counts as empty; an empty text has importance 0; without good labels every importance is 0 and
the draw is uniform; exactly k rows are kept, or all if there are fewer: of rows with equal sums, such as repeated rows, those
with the smaller id, then the smaller hash of the text, and of rows equal in these too any, without changing their number; null
ids come first; a very long text is one row of n-grams in one task; an empty table gives no rows; the text is not kept, other
columns are, except that those named like an output are replaced. Ids are numbers, or texts of whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from docpipe.llm.bpe import pieces
from docpipe.llm.names import free_prefix, others
from docpipe.llm.storage import ship, written

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
OUTPUTS = ("n_grams", "importance", "draw", "kept")


class Hasher:
    """Bucket numbers of the n-grams of texts; hashes of words are kept, up to a bound."""

    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("a power of two is needed")
        self.shift, self.known = np.uint64(64 - buckets.bit_length() + 1), {}

    def __call__(self, text: str) -> np.ndarray:
        words = _TOKEN.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * _MIX ^ (h[1:] + _MIX)) * _MIX
        return (np.concatenate([h, pairs]) >> self.shift).astype(np.int64)


def bucket_counts(docs: DataFrame, good: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts and over those of the given ids. docs: doc_id, text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frozenset(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, target = Hasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if t:
                        n = np.bincount(hasher(t))
                        raw[: len(n)] += n
                        if d in sent.value:
                            target[: len(n)] += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = 300.0) -> np.ndarray:
    """Log of target against raw probability by bucket; ``prior`` n-grams at the raw rate are added to each bucket's counts."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    rate = target.sum() / raw.sum()
    p = raw + prior
    q = target + prior * rate
    return np.log(q / q.sum()) - np.log(p / p.sum())


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a column of 64 bits taken as unsigned, by four counts over 65536 classes each, and how many of the k have it."""
    bits, prefix, left = F.col(column), 0, k
    for shift in (48, 32, 16, 0):
        rows = df if shift == 48 else df.where(F.shiftrightunsigned(bits, shift + 16) == prefix)
        counts = rows.groupBy(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)).alias("c")).count().collect()
        for r in sorted(counts, key=lambda r: -r["c"]):
            if left <= r["count"]:
                prefix = (prefix << 16) | r["c"]
                break
            left -= r["count"]
    return prefix, left


def _flagged(df: DataFrame, size: int, keys: list[str], p: str) -> DataFrame:
    """Adds kept: exactly ``size`` rows with the largest keys, which are unsigned 64-bit columns, compared one after the other."""
    above, level = F.lit(False), F.lit(True)
    left = size
    for key in keys:
        limit, left = kth_largest(df.where(level), key, left)
        signed = limit - (1 << 64) if limit >= 1 << 63 else limit
        value = F.col(key)
        above |= level & (value.bitwiseXOR(F.lit(-(1 << 63))) > F.lit(signed ^ -(1 << 63)))
        level &= value == F.lit(signed)
        ties = df.where(level).count()
        if ties == left:
            return df.withColumn("kept", above | level)
    # Rows that are equal in all keys: the first ``left`` of them, by partition and place in it.
    spot = df.withColumn(f"{p}spot", F.when(level, F.monotonically_increasing_id()))
    spot = written(spot, "resample-ties")
    limit = (1 << 64) - 1 - kth_largest(spot.where(F.col(f"{p}spot").isNotNull()).select((-F.col(f"{p}spot") - 1).alias("c")), "c", left)[0]
    return spot.withColumn("kept", above | F.coalesce(F.col(f"{p}spot") <= limit, F.lit(False))).drop(f"{p}spot")


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int | None = None, share: float | None = None, buckets: int = 1 << 16, max_labelled: int = 20_000, temperature: float | None = 1.0) -> DataFrame:
    """Add n_grams, importance, draw (importance and noise) and kept to each document; the texts are not kept.

    The sample's size is ``k``, or ``share`` of all documents, or else the share of labels with quality 1. Good texts, the
    target, are those with quality 1 that aren't toxic. ``temperature`` divides the importance; None is the importance's
    standard deviation.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("fine"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    marks = marks.where(F.col("good").isNotNull() & F.col("doc_id").isNotNull())
    good = [r["doc_id"] for r in marks.where("good").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()]
    if share is None and k is None:
        share = marks.agg(F.avg(F.col("fine").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    number = F.col(f"`{doc_id}`").cast("long")
    plain = docs.select(number.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    weights = spark.sparkContext.broadcast(log_ratio(*bucket_counts(plain, good, buckets)))
    kept = others(docs.columns, (*OUTPUTS, text))
    p = free_prefix(docs.columns)
    own = [F.xxhash64(F.lit("draw"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias(f"{p}noise"), number.alias(f"{p}id"), F.xxhash64(F.col(f"`{text}`")).alias(f"{p}hash")]
    rest = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(f"{p}text"), *own)
    stay = [*kept, f"{p}noise", f"{p}id", f"{p}hash"]
    schema = T.StructType([*[f for f in rest.schema.fields if f.name != f"{p}text"], T.StructField("n_grams", T.LongType()), T.StructField("importance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(buckets), weights.value
        for batch in batches:
            for part in pieces(batch, f"{p}text"):
                n, score = [], []
                for t in part.column(f"{p}text").to_pylist():
                    found = hasher(t) if t else np.zeros(0, np.int64)
                    n.append(len(found))
                    score.append(float(table[found].sum()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in stay], pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=[*stay, "n_grams", "importance"])

    scored = written(rest.mapInArrow(run, schema), "resample-scores")
    n, spread = scored.agg(F.count(F.lit(1)), F.stddev_pop("importance")).first()
    scale = spread or 1.0 if temperature is None else temperature
    u = (F.shiftrightunsigned(f"{p}noise", 11).cast("double") + 0.5) / float(1 << 53)
    scored = scored.withColumn("draw", F.col("importance") / scale - F.log(-F.log(u)))
    size = k if k is not None else round(share * n)
    if size <= 0 or size >= n:
        return scored.withColumn("kept", F.lit(size > 0)).select(*kept, *OUTPUTS)
    # Unsigned numbers in the order of draw, in steps of 2^-32; then smaller ids, then smaller hashes.
    steps = F.round(F.greatest(F.least(F.col("draw"), F.lit(1e9)), F.lit(-1e9)) * float(1 << 32)).cast("long")
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    first_id = F.when(F.col(f"{p}id").isNull(), F.lit(-1)).otherwise(F.bitwise_not(flip(F.col(f"{p}id"))))
    keyed = scored.withColumn(f"{p}a", flip(steps)).withColumn(f"{p}b", first_id).withColumn(f"{p}c", F.bitwise_not(flip(F.coalesce(f"{p}hash", F.lit(0)))))
    return _flagged(keyed, size, [f"{p}a", f"{p}b", f"{p}c"], p).select(*[F.col(f"`{c}`") for c in kept], *OUTPUTS)
