"""Benchmark decontamination by spaced-seed hashing.

Texts are compared as words: lower case, punctuation as white space, each character of a script without spaces (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) as a word of its own. A seed is a mask over some words in a row that ignores the
places marked 0; the words at the others are hashed. Seeds of documents that occur in the benchmark are hits; around each hit,
on its diagonal, document and item are compared word by word, and the document holds the item if in some window of
``window`` words (of the whole item if that is shorter) all but ``max_wrong`` of each 13 are equal. The two default masks
find every window of 13 words with up to two other words, and of 16 with up to three, wherever these are. Items of fewer than
``exact_below`` words are too short for that: for each of their lengths there is a seed without ignored places, and a document
holds such an item only if it holds all of it word for word.

Items that share a window word for word, directly or over others, are one class, named by its smallest item id. A document is one
row for each class that it holds any item of, and ``items`` of that row lists every item that it holds itself, each with its own best
window: items of a class differ outside of what they share, so a document that holds one need not hold another. Only copies, items of
the same words, are named by the smallest id among them; :func:`item_classes` lists the members of both. All entries of equal seeds
are looked at, in arrays; rows go out in batches, so their number in memory stays bounded where many documents hold many items.

A benchmark of up to ``block_words`` words goes to the workers as one broadcast, and the documents are read once. A larger one is
cut into blocks; a first pass with a filter of all seeds, of at most 32 MB, leaves the documents that may hold any, and only
these, written once, meet each block. A block's broadcast is released before the next one is made.

Defined results: null and empty texts hold nothing; null items and those without words are left out, as are those with a null id
and those of fewer than ``min_item_words`` words, of which there are none by default; repeated items are one; rows that repeat are
each reported; very long texts are searched in one task; extra columns stay in the documents of :func:`clean`; an empty benchmark
or table gives no leaks. Ids are numbers, or texts of whole numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docpipe.llm.bpe import pieces
from docpipe.llm.graph import components
from docpipe.llm.scripts import MARKS, UNSPACED
from docpipe.llm.storage import shared_dir, ship, written

MASKS = ("110111", "100100111")
WINDOW, MAX_WRONG, MIN_ITEM_WORDS, EXACT_BELOW = 13, 2, 1, 9
_FOLD = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(128)) + bytes(range(128, 256))
_EDGE = b"\x7f"
_TABLE_BITS = 22
_FILTER_BITS = 28  # of the filter for several blocks, at most: 32 MB
_EXPANDED = 500_000  # entries of hits looked at at once, and words compared at once
_FOUND = ("item_id", "n_equal", "first_word")

_UNSPACED = re.compile(f"[{UNSPACED}]")
_EITHER = re.compile(f"[{UNSPACED}{MARKS}]")


def spaced(text: str) -> str:
    """Lower case, with characters of scripts without spaces apart."""
    text = text.lower()
    if text.isascii() or not _EITHER.search(text):
        return text
    return _EITHER.sub(lambda m: f" {m[0]} " if _UNSPACED.match(m[0]) else " ", text)


def folded(text: str) -> list[bytes]:
    return spaced(text).encode("utf-8", "surrogatepass").translate(_FOLD).split()


def seed_keys(mask: str, ids: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each place of the mask over the words' numbers; never 0."""
    n = max(0, len(ids) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out += ids[k : k + n].astype(np.uint64) * factors[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out | np.uint64(1)


def _factors(masks: list[str]) -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 63, max(map(len, masks)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts between sizes so that each part adds up to ``most`` at most, or is one of them."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    b = 0
    while b < len(sizes):
        a, b = b, max(b + 1, int(np.searchsorted(upto, upto[b] + most, "right")) - 1)
        yield a, b


class Seeds:
    """A block of the benchmark, ready to be searched for. items: (item id, text), or (item id, text, class id)."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...] = MASKS, window: int = WINDOW, max_wrong: int = MAX_WRONG, min_item_words: int = MIN_ITEM_WORDS, exact_below: int = EXACT_BELOW):
        words = sorted({(i[2] if len(i) > 2 else i[0], i[0], tuple(folded(i[1]))) for i in items if i[1]})
        words = [x for x in words if len(x[2]) >= max(1, min_item_words)]
        self.classes, self.item_ids = (np.array([x[k] for x in words], np.int64) for k in (0, 1))
        names = {w: n for n, w in enumerate(dict.fromkeys(x for _, _, ws in words for x in ws), 2)}
        self.names = names | {_EDGE: 1}
        self.items = [np.array([names[x] for x in ws], np.int32) for _, _, ws in words]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([np.zeros(0, np.int32), *self.items])
        self.window = np.minimum(window, self.sizes)
        self.needed = self.window - np.where(self.sizes >= exact_below, max_wrong * self.window // WINDOW, 0)
        short = sorted({len(x) for x in self.items if len(x) < exact_below})
        self.masks = [*masks, *["1" * n for n in short]]
        self.lengths = [*[range(exact_below, 1 << 62)] * len(masks), *[range(n, n + 1) for n in short]]  # of the items of each
        self.factors = _factors(self.masks)
        tables = [self._table(m) for m in range(len(self.masks))]
        self.entry_item, self.entry_place = (np.concatenate([t[k] for t in tables]) for k in (1, 2))
        first = np.cumsum([0, *[len(t[0]) for t in tables]])
        self.tables = [(t[0], int(n), t[3]) for t, n in zip(tables, first[:-1], strict=True)]  # keys, place of the first one's entry, filter

    def _keys(self, m: int, ids: np.ndarray) -> np.ndarray:
        """0 where a word is none of the benchmark's."""
        mask = self.masks[m]
        n = max(0, len(ids) - len(mask) + 1)
        known = np.ones(n, bool)
        for k, on in enumerate(mask):
            if on == "1":
                known &= ids[k : k + n] > 1
        return np.where(known, seed_keys(mask, ids, self.factors), np.uint64(0))

    def _table(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, item, place = [], [], []
        for n, ids in enumerate(self.items):
            if len(ids) not in self.lengths[m]:
                continue
            k = self._keys(m, ids)
            keys.append(k)
            item.append(np.full(len(k), n, np.int64))
            place.append(np.arange(len(k)))
        k, i, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(k, kind="stable")
        seen = np.zeros(1 << _TABLE_BITS, bool)
        seen[(k >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return k[order], i[order], p[order], seen

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of seeds that the benchmark has, in order; with each its first entry, and how many there are."""
        found = []
        for m, (keys, first, seen) in enumerate(self.tables):
            mine = self._keys(m, ids)
            at = np.flatnonzero((mine != 0) & seen[(mine >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, mine[at], "left"), np.searchsorted(keys, mine[at], "right")
            some = high > low
            found.append((at[some], low[some] + first, (high - low)[some]))
        at, low, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], low[order], n[order]

    def verify(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, diagonal: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, equal words, first word) of the best window of each item on its diagonal between ``begin`` and ``end``, where it is good enough."""
        low, high = np.maximum(begin, diagonal), np.minimum(end, diagonal + self.sizes[item])
        which = np.flatnonzero(high - low >= self.window[item])
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in _portions((high - low)[which], _EXPANDED):
            some = which[a:b]
            size, window = (high - low)[some], self.window[item[some]]
            equal = ids[_ranges(low[some], size)] == self.words[_ranges(self.begins[item[some]] + low[some] - diagonal[some], size)]
            upto = np.concatenate([[0], np.cumsum(equal)])
            windows = size - window + 1
            at = _ranges(np.cumsum(size) - size, windows)
            place = _ranges(np.zeros(len(some), np.int64), windows)
            best = np.maximum.reduceat((upto[at + np.repeat(window, windows)] - upto[at] << 40) - place, np.cumsum(windows) - windows)
            n = -(-best >> 40)
            good = n >= self.needed[item[some]]
            out.append((some[good], n[good], (low[some] + (n << 40) - best)[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _held(self, ids: np.ndarray, edges: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """What :meth:`search` gives, of the hits of some texts; those of more than _EXPANDED entries have to be of one."""
        tried, whole = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = [(np.zeros(0, np.int64),) * 5]
        for a, b in _portions(n, _EXPANDED):
            entry, here = _ranges(low[a:b], n[a:b]), np.repeat(at[a:b], n[a:b])
            item = self.entry_item[entry]
            if len(whole):
                new = ~np.isin(item, whole)
                entry, here, item = entry[new], here[new], item[new]
            diagonal = here - self.entry_place[entry]
            text = np.searchsorted(edges, here, "right") - 1
            # Each diagonal once: within a key texts ascend, as places do.
            key = (diagonal + int(self.sizes.max())) * len(self.items) + item
            order = np.argsort(key, kind="stable")
            changes = (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0)
            order = order[np.concatenate([np.ones(min(1, len(order)), bool), changes])]
            if len(tried):
                order = order[~np.isin(key[order], tried)]
            if b < len(n):
                tried = np.union1d(tried, key[order])
            text, item, diagonal = text[order], item[order], diagonal[order]
            which, equal, first = self.verify(ids, edges[text] + 1, edges[text + 1], diagonal, item)
            text, item = text[which], item[which]
            # No later hit can give a better window than a whole one that starts no later than the hits so far.
            whole = np.union1d(whole, item[(equal == self.window[item]) & (first <= at[b - 1])])
            out.append((text, self.classes[item], self.item_ids[item], equal, first - edges[text] - 1))
        text, classes, item, equal, first = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((first, -equal, item, classes, text))
        changes = (np.diff(text[order]) != 0) | (np.diff(item[order]) != 0)
        order = order[np.concatenate([np.ones(min(1, len(order)), bool), changes])]
        return tuple(x[order] for x in (text, classes, item, equal, first))

    def search(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """(place in ``texts``, class id, item id, equal words in the best window, its first word) of all items that texts hold, in that
        order and as arrays, those of a text together."""
        joined = (" " + _EDGE.decode() + " ").join(spaced((t or "").replace("\x7f", " ")) for t in texts).encode("utf-8", "surrogatepass")
        keep = bytearray(_FOLD)
        keep[0x7F] = 0x7F
        words = joined.translate(bytes(keep)).split()
        ids = np.fromiter(map(self.names.get, words, repeat(0)), np.int32, len(words))
        if not self.items or not len(ids):
            return
        edges = np.concatenate([[-1], np.flatnonzero(ids == 1), [len(ids)]])
        at, low, n = self.hits(ids)
        starts = np.searchsorted(at, edges)  # of the hits of each text
        entries = np.concatenate([[0], np.cumsum(n)])[starts]
        for a, b in _portions(np.diff(entries), _EXPANDED):
            some = slice(starts[a], starts[b])
            if starts[a] < starts[b]:
                yield self._held(ids, edges, at[some], low[some], n[some])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())


def item_classes(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, class_id, same_as) of the items that share a window, or all their words if they have fewer, with another one.

    class_id is the smallest item id of the class, same_as that of the copies: items of the same words, or, where ids repeat, of the
    same set of texts. An item without a copy is its own.
    """
    ship(benchmark.sparkSession)
    shared_dir(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded(t)
                n = min(window, len(words))
                parts = {xxhash.xxh3_128_intdigest(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)} if n else set()
                for x, whole in [*[(x, False) for x in parts], *[(xxhash.xxh3_128_intdigest(b" ".join(words)), True)] * (n > 0)]:
                    for into, v in zip(out, (i, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63), whole), strict=True):
                        into.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.bool_())], names=["item_id", "h1", "h2", "whole"])

    hashes = written(_items(benchmark).mapInArrow(run, "item_id long, h1 long, h2 long, whole boolean"), "leak-windows")
    windows, texts = hashes.where(~F.col("whole")).drop("whole"), hashes.where("whole").drop("whole").distinct()
    first = windows.groupBy("h1", "h2").agg(F.min("item_id").alias("a"), F.max("item_id").alias("z")).where(F.col("a") < F.col("z"))
    found = components(windows.join(first, ["h1", "h2"]).select("a", F.col("item_id").alias("b")))
    found = found.select(F.col("node").alias("item_id"), F.col("component").alias("class_id"))
    own = texts.groupBy("item_id").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    same = own.join(own.groupBy("h1", "h2").agg(F.min("item_id").alias("same_as")), ["h1", "h2"])
    return found.join(same.select("item_id", "same_as"), "item_id")


def blocks(benchmark: DataFrame, block_words: int, make: Callable[[list[tuple]], Seeds] = Seeds) -> Iterator[Seeds]:
    """The benchmark with its classes in blocks of bounded size, by items in a fixed order, copies once; only one block is on the driver at a time."""
    rows = _items(benchmark).distinct().join(item_classes(benchmark), "item_id", "left")
    rows = rows.select(F.coalesce("same_as", "item_id").alias("item_id"), "text", F.coalesce("class_id", "item_id").alias("class_id")).distinct()
    rows = written(rows, "leak-items")
    n = _block_count(rows, block_words)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield make([(r["item_id"], r["text"], r["class_id"]) for r in part.collect()])


def _block_count(items: DataFrame, block_words: int) -> int:
    words = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    total = items.agg(F.sum(words)).first()[0] or 0
    return 1 if total <= block_words else math.ceil(2 * total / block_words)


class SeedFilter:
    """Says of a text whether it may hold a seed of the benchmark."""

    def __init__(self, bits: int, table: np.ndarray, all_masks: list[str], masks: list[str]):
        self.bits, self.table, self.masks, self.factors = bits, table, masks, _factors(all_masks)

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def may_hold(self, text: str | None) -> bool:
        ids = self.hashes(folded(text)) if text else np.zeros(0, np.uint64)
        for mask in self.masks:
            slot = seed_keys(mask, ids, self.factors) >> np.uint64(64 - self.bits)
            if (self.table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).any():
                return True
        return False


def seed_filter(benchmark: DataFrame) -> SeedFilter:
    """Of all seeds of the benchmark, in 8 bits for each, but 2^28 bits at most."""
    ship(benchmark.sparkSession)
    items = written(_items(benchmark), "leak-filter-items")
    count = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", f"[^{UNSPACED}]", ""))
    bits = min(_FILTER_BITS, max(16, math.ceil(math.log2(16 * (items.agg(F.sum(count)).first()[0] or 1)))))
    masks = [*MASKS, *["1" * n for n in range(1, EXACT_BELOW)]]
    factors = _factors(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots: dict[int, list] = {0: [np.zeros(0, np.uint64)]}
            for t in batch.column("text").to_pylist():
                ids = SeedFilter.hashes(folded(t))
                short = len(ids) if len(ids) < EXACT_BELOW else 0
                for m in ["1" * short] if short else MASKS if len(ids) else []:
                    slots.setdefault(short, []).append(seed_keys(m, ids, factors) >> np.uint64(64 - bits))
            for short, found in slots.items():
                slot = np.unique(np.concatenate(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), short, np.int64))], names=["slot", "short"])

    seeds = written(items.mapInArrow(run, "slot long, short long"), "leak-seeds")
    bit = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    rows = seeds.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    short = sorted(r["short"] for r in seeds.select("short").distinct().collect() if r["short"])
    return SeedFilter(bits, table, masks, [*MASKS, *["1" * n for n in short]])


def _searched(docs: DataFrame, sent, text: str, schema, each: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield from each(part, sent.value)

    return docs.mapInArrow(run, schema)


def _candidates(docs: DataFrame, benchmark: DataFrame, text: str, name: str) -> DataFrame:
    """The rows that may hold an item, written."""
    sent = docs.sparkSession.sparkContext.broadcast(seed_filter(benchmark))
    left = written(_searched(docs, sent, text, docs.schema, lambda part, f: [part.filter(pa.array(list(map(f.may_hold, part.column(text).to_pylist())), pa.bool_()))]), name)
    sent.destroy()
    return left


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", block_words: int = 2_000_000) -> DataFrame:
    """One row for each document and class that it holds items of: doc_id, item_id (of the class), n_equal (words in the best window),
    first_word, items (those that it holds, copies once: item_id, n_equal, first_word)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, n_equal long, first_word long, items array<struct<item_id: long, n_equal: long, first_word: long>>"

    def each(part: pa.RecordBatch, seeds: Seeds) -> Iterator[pa.RecordBatch]:
        for doc, classes, *found in seeds.search(part.column("text").to_pylist()):
            if not len(doc):
                continue
            _, equal, first = found
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(classes) != 0)]))
            best = np.maximum.reduceat((equal << 40) - first, starts)
            n = -(-best >> 40)
            items = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(doc)], pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=_FOUND))
            columns = [part.column("doc_id").take(pa.array(doc[starts])), *[pa.array(x, pa.int64()) for x in (classes[starts], n, (n << 40) - best)], items]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_FOUND, "items"])

    if _block_count(_items(benchmark), block_words) == 1:
        return _searched(docs, spark.sparkContext.broadcast(next(blocks(benchmark, block_words))), "text", schema, each)
    docs = written(_candidates(docs, benchmark, "text", "leak-candidates").withColumn("row", F.monotonically_increasing_id()), "leak-rows")
    rows, out = docs.select(F.col("row").alias("doc_id"), "text"), None
    for seeds in blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(seeds)
        found = written(_searched(rows, sent, "text", schema, each), "leak-block")
        sent.destroy()
        out = found if out is None else out.unionAll(found)
    # A class may have items in several blocks, and an item texts in several; the first of the best windows counts.
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("w"))).alias("b")
    each_item = out.select("doc_id", F.col("item_id").alias("class_id"), F.inline("items")).groupBy("doc_id", "class_id", "item_id").agg(best)
    each_item = each_item.select("doc_id", "class_id", F.struct("item_id", "b.n_equal", (-F.col("b.w")).alias("first_word")).alias("i"))
    named = each_item.groupBy(F.col("doc_id").alias("row"), F.col("class_id").alias("item_id")).agg(
        F.max(F.struct("i.n_equal", (-F.col("i.first_word")).alias("w"))).alias("b"), F.sort_array(F.collect_list("i")).alias("items")
    )
    return named.join(docs.select("row", "doc_id"), "row").select("doc_id", "item_id", "b.n_equal", (-F.col("b.w")).alias("first_word"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = 2_000_000) -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    spark = docs.sparkSession
    ship(spark)

    def kept(part: pa.RecordBatch, seeds: Seeds) -> Iterator[pa.RecordBatch]:
        free = np.ones(part.num_rows, bool)
        for doc, *_ in seeds.search(part.column(text).to_pylist()):
            free[doc] = False
        yield part.filter(pa.array(free))

    if _block_count(_items(benchmark), block_words) == 1:
        return _searched(docs, spark.sparkContext.broadcast(next(blocks(benchmark, block_words))), text, docs.schema, kept)
    shared_dir(spark)
    free = _searched(docs, spark.sparkContext.broadcast(seed_filter(benchmark)), text, docs.schema, lambda part, f: [part.filter(pa.array([not f.may_hold(t) for t in part.column(text).to_pylist()], pa.bool_()))])
    left = _candidates(docs, benchmark, text, "leak-candidates")
    for seeds in blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(seeds)
        left = written(_searched(left, sent, text, docs.schema, kept), "leak-left")
        sent.destroy()
    return free.unionAll(left)
