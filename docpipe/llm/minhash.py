"""Near-duplicate documents by circulant MinHash.

A document is the set of its five-word shingles. Two fixed permutations of the 32-bit numbers give the whole signature: the
first is applied to a shingle's hash once, the second after a shift of that by k steps for coordinate k; the coordinate is the
smallest result over the set. Signatures are cut into bands, and sets that agree in a band meet in a bucket.

Every bucket's sets are compared in full. Equal sets are one node from the start. Buckets with the same members are kept once.
A bucket goes to one task with its sets; a set of which too few shingles occur in any other set of the bucket can't be linked
and is put aside, the others are compared through an inverted index, only as far as they aren't yet connected. Links become
components by star contraction.

Buckets of more than ``block`` sets, or of more than ``block_bytes`` of shingles, are cut into blocks. A few sets of the bucket
(about ``hubs``, chosen by hash) go to all blocks, each other set to its own, so sets that are like the hubs, as the variants
of one page are, come together in work that grows with the bucket. Only sets that aren't with most of their bucket after that
are compared with every other block. That finds the same components as all pairs of blocks would; nothing is capped.

With 22 bands of 4, a pair at the threshold of 0.85 misses all buckets once in about 10 million times, one at 0.80 once in
about 100,000; nothing is ever linked without the exact comparison.

Defined results: null texts, empty texts and texts without words have an empty set and are linked with nothing; fewer than
five words are one shingle; a very long text is one set of 8 bytes a shingle in one task; rows with a null id are linked with
nothing and stay; rows of one id are one document, linked by any of their texts, so :func:`mark` gives them one component;
:func:`dedup` goes by texts and keeps of each group of like texts the rows of the smallest id and set, so a text goes only if
one like it, directly or over others, stays; rows that repeat id and text stay or go together; an empty table gives no rows;
:func:`dedup` keeps extra columns. Ids are numbers, or texts of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from docpipe.llm.bpe import pieces
from docpipe.llm.graph import components
from docpipe.llm.names import free_prefix
from docpipe.llm.storage import shared_dir, ship, sieved, written

BANDS, ROWS, BLOCK, BLOCK_BYTES, HUBS = 22, 4, 500, 16_000_000, 8
_WORDS_IN_SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint32(0x9E3779B1)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int = _WORDS_IN_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, and ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        out = out * _P + _mix64(h[k : k + n])
    return np.unique(_mix64(out))


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` coordinates: the second permutation after each of k shifts of the first."""
    first = _permuted((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    shifts = np.arange(k, dtype=np.uint32) * _STEP
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 1024):
        np.minimum(out, _permuted(first[at : at + 1024][None, :] + shifts[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band."""
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig.reshape(bands, rows).T:
        h = _mix64(h * _P + column.astype(np.uint64))
    return h.view(np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets which reach ``percent`` of Jaccard similarity, directly or over others."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    alive = np.arange(len(sets))
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for _ in range(3):  # put sets aside that share too few shingles with all others together
        _, back, df = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.bincount(owner[df[back] > 1], minlength=len(sets))
        stay = alive[100 * common[alive] >= percent * sizes[alive]]
        if len(stay) == len(alive):
            break
        alive = stay
        mask = np.zeros(len(sets), bool)
        mask[alive] = True
        flat, owner = flat[mask[owner]], owner[mask[owner]]
    if len(alive) < 2:
        return []
    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))
    group = np.arange(len(sets))
    links: list[tuple[int, int]] = []

    def compare(i: int) -> None:
        mine = token[begin[i] : begin[i + 1]]
        low, n = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        both = np.bincount(posting[at], minlength=len(sets))
        hit = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (group != group[i]) & (both > 0))
        for j in hit.tolist():
            if group[j] != group[i]:
                links.append((i, j))
                a, b = sorted((group[i], group[j]))
                group[group == b] = a

    # The set with the most in common first: if it connects most others, only the rest is left to be compared.
    weight = np.bincount(owner, weights=np.bincount(token)[token], minlength=len(sets))
    hub = int(alive[np.argmax(weight[alive])])
    compare(hub)
    done = np.zeros(len(sets), bool)
    done[hub] = True
    while True:
        left = np.unique(group[alive])
        if len(left) < 2:
            return links
        # All of the largest group may stay uncompared: what is outside is compared with all.
        counts = np.bincount(group[alive], minlength=len(sets))
        largest = int(np.argmax(counts))
        todo = alive[(group[alive] != largest) & ~done[alive]]
        if not len(todo):
            return links
        done[todo[0]] = True
        compare(int(todo[0]))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text; null is the empty text."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]


def _signed(docs: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, t1, t2) with n_shingles, the set's key (s1, s2) and its bands; t1 and t2 are hashes of the text."""
    docs = docs.select("doc_id", text, *text_keys(F.col(text)))
    schema = "doc_id long, t1 long, t2 long, n_shingles long, s1 long, s2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                n, s1, s2, keys = [], [], [], []
                known: dict[str, tuple] = {}
                for t in part.column(text).to_pylist():
                    if t not in known:
                        x = shingle_set(t)
                        known[t] = (len(x), *set_key(x), band_keys(signature(x, bands * rows), bands, rows)) if len(x) else (0, None, None, None)
                    for into, v in zip((n, s1, s2, keys), known[t], strict=True):
                        into.append(v)
                own = [part.column(c) for c in ("doc_id", "t1", "t2")]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.int64()) for x in (n, s1, s2)], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, schema)


def _ordered_text(number: Column) -> Column:
    """16 hexadecimal digits that order like the number."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _number_of(ordered: Column) -> Column:
    return (F.conv(ordered, 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _compared(tasks: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, a_set, b, b_set) of the sets that meet in a task. tasks: (first_id, s1, s2, tasks), docs: (doc_id, text)."""
    tasks = written(tasks, "minhash-tasks")
    docs = sieved(docs, "doc_id", tasks, "first_id")  # most texts share no bucket and stay where they are
    dealt = tasks.join(docs, F.col("first_id") == F.col("doc_id")).select("first_id", "s1", "s2", "tasks", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                out: dict[str, list] = {c: [] for c in ("bucket", "x", "y", "first_id", "s1", "shingles")}
                for d, s1, s2, where, t in zip(*(part.column(c).to_pylist() for c in ("first_id", "s1", "s2", "tasks", "text")), strict=True):
                    x = shingle_set(t)
                    if not len(x) or set_key(x) != (s1, s2):
                        continue  # another row of this id
                    data = x.tobytes()
                    for w in where:
                        for c in ("bucket", "x", "y"):
                            out[c].append(w[c])
                        out["first_id"].append(d)
                        out["s1"].append(s1)
                        out["shingles"].append(data)
                        if len(out["s1"]) * len(data) > 8_000_000:
                            yield sent(out)
                yield sent(out)

    def sent(out: dict[str, list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))
        for x in out.values():
            x.clear()
        return batch

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int, int, int]] = []
        key, sets = None, {}

        def close() -> None:
            nodes, found = list(sets), linked([np.frombuffer(x, np.uint64) for x in sets.values()], percent)
            links.extend((*nodes[i], *nodes[j]) for i, j in found)

        def links_so_far() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(4)], names=["a", "a_set", "b", "b_set"])
            links.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "first_id", "s1")]
            for k, (*now, d, s1) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if len(sets) > 1:
                        close()
                    key, sets = now, {}
                sets[d, s1] = batch.column("shingles")[k].as_py()
            if len(links) > 10_000:
                yield links_so_far()
        if len(sets) > 1:
            close()
        yield links_so_far()

    expanded = dealt.mapInArrow(expand, "bucket long, x int, y int, first_id long, s1 long, shingles binary")
    return expanded.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(compare, "a long, a_set long, b long, b_set long")


def find_components(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, hubs: int = HUBS, by_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns (doc_id, t1, t2, n_shingles, s1, s2) by row and (s1, s2, component_id, component_set) by distinct set.

    ``by_id``: sets of one id are one node. ``component_set`` is the s1 of the component's first set of the id ``component_id``.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_dir(spark)
    signed = written(_signed(docs, "text", bands, rows), "minhash-signatures")
    nodes = signed.where(F.col("s1").isNotNull() & F.col("doc_id").isNotNull())
    sets = written(nodes.groupBy("s1", "s2").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "minhash-sets")
    # Ids with rows of different sets. Where there are none, a set's smallest id stands for it alone.
    mixed = nodes.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("s1", "s2")])
    mixed = written(mixed.where((F.col("min_s1") < F.col("max_s1")) | (F.col("min_s2") < F.col("max_s2"))).select("doc_id"), "minhash-mixed")
    plain = mixed.isEmpty()

    def node(first: str, which: str) -> Column:
        return F.col(first) if plain else F.concat(_ordered_text(F.col(first)), _ordered_text(F.col(which)))

    # Buckets of two or more sets; those with the same members are one.
    member = F.xxhash64("s1", "s2")
    keyed = sets.select("first_id", "s1", "s2", "n_shingles", F.explode("bands").alias("bucket"))
    marks = [F.min(member).alias("low"), F.bit_xor(member).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "s1", "s2")).alias("mark2")]
    buckets = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), (F.sum("n_shingles") * 8).alias("bytes"), *marks)
    buckets = buckets.where(F.col("size") > 1).groupBy("size", "bytes", "low", "mark", "mark2").agg(F.min("bucket").alias("bucket"))
    n = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("int")
    buckets = written(buckets.select("bucket", "size", F.least(n, F.col("size").cast("int")).alias("n")), "minhash-buckets")
    met = sieved(keyed, "bucket", buckets, "bucket").join(buckets, "bucket").withColumn("own", F.pmod(member, F.col("n")).cast("int"))
    is_hub = (F.col("n") > 1) & (F.pmod(F.xxhash64(F.lit(2), "s1", "s2"), F.ceil(F.col("size") / hubs)) == 0)
    task = lambda x, y: F.struct(F.col("bucket").alias("bucket"), x.alias("x"), y.alias("y"))
    first = F.when(is_hub, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: task(k, k))).otherwise(F.array(task(F.col("own"), F.col("own"))))

    def tasks(of: DataFrame, each: Column) -> DataFrame:
        return of.groupBy("first_id", "s1", "s2").agg(F.flatten(F.collect_list(each)).alias("tasks"))

    def as_nodes(links: DataFrame) -> DataFrame:
        return links.select(node("a", "a_set").alias("a"), node("b", "b_set").alias("b"))

    links = as_nodes(_compared(tasks(met, first), docs, percent))
    if not buckets.where("n > 1").isEmpty():
        links = written(links, "minhash-links")
        # Sets of cut buckets that aren't with most of their bucket yet meet all blocks of it.
        known = components(links)
        of = node("first_id", "s1")
        cut = met.where("n > 1").select("first_id", "s1", "s2", "bucket", "n", "own", of.alias("of"))
        cut = cut.join(known, F.col("of") == F.col("node"), "left").withColumn("group", F.coalesce("component", "of")).drop("of", "node", "component")
        cut = written(cut, "minhash-cut")
        groups = cut.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("k"))
        main = groups.groupBy("bucket").agg(F.max_by("group", "k").alias("main"), (F.sum("k") - F.max("k")).alias("rest"))
        main = written(main.where(F.col("rest") > 0), "minhash-rest")
        parts = F.ceil(F.col("rest") / block).cast("int")
        cut = cut.join(main, "bucket").withColumn("parts", parts)
        to_all = lambda count, make: F.transform(F.sequence(F.lit(0), count - 1), make)
        mine = F.when(F.col("group") != F.col("main"), to_all(F.col("n"), lambda k: task(F.pmod(F.xxhash64(F.lit(3), "s1", "s2"), F.col("parts")).cast("int"), k)))
        others_ = to_all(F.col("parts"), lambda k: task(k, F.col("own")))
        links = links.unionAll(as_nodes(_compared(tasks(cut, F.array_distinct(F.concat(F.coalesce(mine, F.array().cast("array<struct<bucket:bigint,x:int,y:int>>")), others_))), docs, percent)))
    if by_id and not plain:
        held = nodes.join(mixed, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct().join(sets, ["s1", "s2"]).select("doc_id", node("first_id", "s1").alias("b"))
        held = written(held, "minhash-held")
        links = links.unionAll(held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b"))
    joined = components(links)
    found = sets.select("s1", "s2", node("first_id", "s1").alias("of")).join(joined, F.col("of") == F.col("node"), "left").withColumn("root", F.coalesce("component", "of"))
    root = (F.col("root"), F.lit(None).cast("long")) if plain else (_number_of(F.substring("root", 1, 16)), _number_of(F.substring("root", 17, 16)))
    return signed.drop("bands"), found.select("s1", "s2", root[0].alias("component_id"), root[1].alias("component_set"))


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed, found = find_components(plain, **how)
    joined = signed.join(found, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "s1", "s2", "t1", "t2", "component_set")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents without those of which a near duplicate with a smaller id, or of the same id with a smaller set, stays."""
    p = free_prefix(docs.columns)
    marked = mark(docs, text, doc_id, by_id=False, **how)
    first = F.col("kept") & F.coalesce(F.col("component_set") == F.col("s1"), F.lit(True))
    gone = marked.where(~first).select(*[F.col(c).alias(p + c) for c in ("doc_id", "t1", "t2")]).distinct()
    t1, t2 = text_keys(F.col(f"`{text}`"))
    same = (F.col(f"`{doc_id}`").cast("long") == F.col(f"{p}doc_id")) & (t1 == F.col(f"{p}t1")) & (t2 == F.col(f"{p}t2"))
    return docs.join(gone, same, "left_anti")
