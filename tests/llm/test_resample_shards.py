"""Resampling and sharding against plain versions."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docpipe.llm import resample, sharding

SCHEMA = "doc_id long, text string, KEPT string, shard string, _x int"
FINE, JUNK = [f"w{i}" for i in range(200)], ["$$$", "###", "zz"]


def made(seed, n=300):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(FINE if i % 4 else FINE + JUNK * 60) for _ in range(rng.randint(20, 60))), "k", "s", 1) for i in range(n)]


def plain_importance(texts, good, buckets=1 << 16, prior=300.0):
    """texts: in order; good: whether each is in the target."""
    hasher = resample.Hasher(buckets)
    grams = [hasher(t).tolist() if t else [] for t in texts]
    raw, target = Counter(), Counter()
    for g, fine in zip(grams, good, strict=True):
        raw.update(g)
        if fine:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    if not n or not m:
        return [0.0] * len(texts)
    total_p, total_q = n + prior * buckets, m + prior * (m / n) * buckets
    score = {b: math.log((target[b] + prior * m / n) / total_q) - math.log((raw[b] + prior) / total_p) for b in raw}
    return [sum(score[b] for b in g) for g in grams]


def test_resampling_matches_a_plain_version(spark):
    rows = [*made(1), (900, None, None, None, None), (901, "", None, None, None), (None, "w1 w2", None, None, None), (902, "w1 $$$ " * 60_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labelled = {i: (int(i % 4 > 0), int(i % 20 == 1)) for i in range(0, 300, 3)}
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in labelled.items()] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    good = [labelled.get(r[0]) == (1, 0) for r in rows]
    want = dict(zip([r[0] for r in rows], plain_importance([r[1] for r in rows], good), strict=True))
    for temperature in (1.0, None, 50.0):
        got = resample.resample(docs, labels, k=120, temperature=temperature).collect()
        assert len(got) == len(rows) and [r for r in resample.OUTPUTS if r not in got[0].asDict()] == []
        for r in got:
            assert math.isclose(r.importance, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-6)
        assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.draw)[:120]}
    noise = [r.draw - r.importance / 50 for r in got]
    assert -2.5 < min(noise) and 0.3 < np.mean(noise) < 0.9  # Gumbel: mean 0.58


def test_resampling_keeps_exactly_k_of_ties(spark):
    docs = spark.createDataFrame([(5, "same text here", "", "", 0)] * 6 + [(i, None, "", "", 0) for i in (8, 9)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    for k in range(9):
        assert sum(r.kept for r in resample.resample(docs, labels, k=k).collect()) == k
    flat = spark.createDataFrame([(i % 50, "t", "", "", 0) for i in range(100)], SCHEMA)
    keyed = resample._flagged(flat.selectExpr("doc_id", "bigint(7) AS a", "bigint(50 - doc_id) AS b"), 31, ["a", "b"], "_")
    kept = [r.doc_id for r in keyed.collect() if r.kept]
    assert sorted(kept) == sorted([*range(15), *range(15), 15])


def test_resampling_on_labels_that_it_has_not_seen(spark):
    docs = spark.createDataFrame(made(2, 800), SCHEMA)
    seen = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = [r for r in resample.resample(docs, seen, k=600).collect() if r.doc_id >= 400]
    right = sum(r.kept == (r.doc_id % 4 > 0) for r in got)
    assert right >= 0.95 * len(got)


def plain_differencing(sizes, k):
    """Sums of the k sets, by lists of all partial partitions."""
    heap = [(-s, n, [0] * (k - 1) + [s]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
        heapq.heappush(heap, (c[0] - c[-1], n, c))
        n += 1
    return heap[0][2]


@pytest.mark.parametrize("parts", [1000, 60])
def test_shards_match_a_plain_version(spark, parts):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 400))) for _ in range(250)]
    rows = [(i, rng.choice([t, t, texts[0], None, ""]), "k", "s", 1) for i, t in enumerate(texts)] + [(None, texts[3], "", "", 1), (7, texts[4], "", "", 1), (7, texts[4], "", "", 1)]
    if parts == 1000:  # longer than all others together
        rows.append((600, "long " * 100_000, "", "", 1))
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), shards=6, groups_in_part=parts, fan_in=2, rows_in_part=50).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    groups = Counter()
    for _, t, *_ in rows:
        groups[t] += size(t)
    sums, slots, where = Counter({s: 0 for s in range(6)}), defaultdict(list), defaultdict(set)
    for r in got:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r["size"], r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(6))
    assert all(len(s) == 1 for (n, _), s in where.items() if n > 8)
    left, best = sorted(groups.values(), reverse=True), []
    while left[0] * (6 - len(best)) >= sum(left):
        best.append(left.pop(0))  # a shard to itself
    assert len(best) == (2 if parts == 1000 else 1)
    best = sorted([*best, *plain_differencing(left, 6 - len(best))])
    if parts == 1000:
        assert sorted(sums.values()) == best
    else:
        assert all(abs(a - b) <= 64 for a, b in zip(sorted(sums.values()), best, strict=True))
    assert {"KEPT", "_x"} <= set(got[0].asDict())
