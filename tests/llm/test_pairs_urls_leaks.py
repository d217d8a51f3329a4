import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docpipe.llm import decontaminate, minhash, resample, urls
from docpipe.llm.queries import URL_RULES
from tests.llm import brute

SCHEMA = "doc_id long, text string, kept string"


def near_corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["The", "of", "é", *[f"w{i}" for i in range(400)]]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts[-40:]).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    i = rng.randrange(len(w))
                    w[i : i + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            texts.append("\n".join([" ".join(w[:20]), "\t".join(w[20:])]))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 120, 300]))))
    return [(i, t if t or i % 2 else None, "k") for i, t in enumerate(texts)]


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus(1)
    want = brute.components([r[:2] for r in rows])
    docs = spark.createDataFrame([*rows, (None, rows[5][1], "k"), (None, None, None)], SCHEMA)
    for block in (2000, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.mark(docs, block=block).collect() if r.doc_id is not None}
        assert got == want
    assert sum(c != d for d, (_, c) in want.items()) > 40
    left = minhash.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(d for d, (_, c) in want.items() if c == d)
    assert left.where("doc_id is null").count() == 2
    assert minhash.mark(docs.where(F.lit(False))).count() == 0


def test_near_duplicates_of_large_buckets(spark):
    # Variants of one page in a chain, and pages apart from them: more than one block, with and without sets left over.
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(300)], []
    for i in range(160):
        w = list(words)
        for k in range(i % 7):
            w[(11 * i + 40 * k) % 300] = f"x{i}-{k}"
        rows.append((i, " ".join(w), "k"))
    far = [rng.choice([f"y{k}", words[k]]) for k in range(300)]
    rows += [(500 + i, " ".join([*far[: 290 - i], *[f"z{i}-{k}" for k in range(4)]]), "k") for i in range(30)]
    want = brute.components([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA)
    for how in ({"block": 12, "hubs": 2}, {"block_bytes": 30_000, "hubs": 1}, {"block": 5, "hubs": 1, "rows": 1, "bands": 8}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.mark(docs, **how).collect()} == want


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(4, a, "k"), (5, a, "k"), (5, b, "k"), (6, b, "k"), (6, b, "k"), (7, c, "k"), (None, b, "k"), (8, "long " * 300_000, "k"), (9, None, "k"), (9, "", "k")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.mark(docs).collect()}
    assert marked == {(4, 36): (4, True), (5, 36): (4, False), (6, 36): (4, False), (7, 36): (7, True), (None, 36): (None, True), (8, 1): (8, True), (9, 0): (9, True)}
    left = sorted((r.doc_id or 0, r.text or "") for r in minhash.dedup(docs).collect())
    assert left == sorted([(0, b), (4, a), (5, b), (7, c), (8, rows[7][1]), (9, ""), (9, "")])


def test_linked_connects_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 150).astype(np.uint64)
    sets = []
    for _ in range(120):
        x = base.copy()
        x[rng.choice(150, rng.integers(0, 40), replace=False)] = rng.integers(0, 1 << 60)
        sets.append(np.unique(x))
    got, want = list(range(120)), list(range(120))

    def join(g, i, j):
        a, b = g[i], g[j]
        g[:] = [min(a, b) if x in (a, b) else x for x in g]

    for i, j in itertools.combinations(range(120), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
            join(want, i, j)
    for i, j in minhash.linked(sets, 85):
        join(got, i, j)
    assert got == want


def judged(url):
    url = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.where), default=None)
    return host, path, best and best.where, best and best.verdict


def test_urls(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "com", "evilexample.com", "bad.org", "good.org"]
    made = [f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/a/1', '/fr/?q=1', '?x://y/', '#t', '/spam/offer-12'])}" for _ in range(600)] + [None, "", "no scheme", "://", "a://b://c/d", "x\ny://h/p"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(made)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(i, int(not (u and "spam" in u)), 0) for i, u in enumerate(made) if i % 2] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge(pages, labels, URL_RULES, min_count=5, min_confidence=0.95).collect()}
    assert len(got) == len(made)
    for i, u in enumerate(made):
        host, path, rule, verdict = judged(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))
        assert r.mined == bool(u and "/spam/" in u)
    plain = urls.judge(pages, labels.where(F.lit(False)), URL_RULES)
    assert plain.where("mined").count() == 0
    assert plain.where(F.lit(False)).count() == 0


def test_masks_find_every_window_that_counts():
    on = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for size, most in ((13, 2), (16, 3), (9, 1)):
        for wrong in itertools.combinations(range(size), most):
            assert any(all(s + i not in wrong for i in m) for m, mask in zip(on, decontaminate.MASKS, strict=True) for s in range(size - len(mask) + 1))


def plain_words(text):
    """Words as the operator takes them, character by character."""
    out = ""
    for c in (text or "").lower():
        if "\u0e00" <= c <= "\u0eff" or "\u3041" <= c <= "\u30fa" or "\u4e00" <= c <= "\u9fff":
            out += f" {c} "
        elif c < "\x80" and not c.isalnum() or "\u3000" <= c <= "\u303f" or "\uff01" <= c <= "\uff0f":
            out += " "
        else:
            out += c
    return [w for w in out.split(" ") if w]


def brute_classes(items, window=13):
    holders, root = {}, {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in items:
        v = plain_words(x)
        k = min(window, len(v))
        for q in range(len(v) - k + 1 if k else 0):
            a, b = find(holders.setdefault(tuple(v[q : q + k]), i)), find(i)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def brute_leaks(docs, items):
    """(document, class of items) pairs."""
    out, classes = set(), brute_classes(items)
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            v = plain_words(x)
            k = min(13, len(v))
            wrong = 2 * k // 13 if len(v) >= 9 else 0
            if k and any(sum(a == b for a, b in zip(w[p : p + k], v[q : q + k], strict=True)) + wrong >= k for p in range(len(w) - k + 1) for q in range(len(v) - k + 1)):
                out.add((d, classes[i]))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 16, 20, 40])))) for i in range(20)] + [(90, None), (91, "")]
    shared = " ".join(rng.choice(words) for _ in range(30))
    items += [(100 + i, f"{rng.choice(words)} {rng.choice(words)} {shared} {rng.choice(words)}") for i in range(25)] + [(15, items[15][1])]
    docs = []
    for d in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            p = rng.choice(items[:20])[1].split(" ")
            for _ in range(rng.randint(0, 6)):
                p[rng.randrange(len(p))] = rng.choice(words)
            at = rng.randint(0, len(w))
            w[at:at] = p
        if d % 10 == 1:
            w += shared.split(" ")[rng.randint(0, 12) :]
        docs.append((d, rng.choice([" ", ", "]).join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, " ".join(rng.choice(words) for _ in range(30_000)) + " " + items[8][1] + " end")]
    frame = spark.createDataFrame([(*d, "k") for d in docs], SCHEMA)
    bench = spark.createDataFrame([*items, (None, "not an item")], "item_id long, text string")
    want = brute_leaks(docs, items)
    for size in (2_000_000, 300):
        got = decontaminate.find_leaks(frame, bench, block_words=size).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
        for r in got:
            assert (r.n_equal >= 11 or r.n_equal == 5) and r.first_word < 31_000
        left = decontaminate.clean(frame, bench, block_words=size)
        assert left.columns == frame.columns
        assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in docs if d not in {x for x, _ in want})
    assert len(want) > 25 and sum(c == 100 for _, c in want) >= 15
    classes = {r.item_id: r.class_id for r in decontaminate.item_classes(bench).collect()}
    assert classes == {i: c for i, c in brute_classes(items).items() if i >= 100}
    assert decontaminate.find_leaks(frame, bench.where(F.lit(False))).count() == 0
    assert decontaminate.find_leaks(frame.where(F.lit(False)), bench).count() == 0


def test_resampling(spark):
    rng = random.Random(4)
    fine, junk = [f"w{i}" for i in range(200)], ["$$$", "###", "zz"]
    rows = [(i, " ".join(rng.choice(fine if i % 4 else fine + junk * 60) for _ in range(rng.randint(20, 60))), "k") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", None), (None, "w1 w2", None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels).collect()
    assert len(got) == 403 and sum(r.kept for r in got) == round(403 * sum(i % 4 > 0 for i in range(0, 400, 3)) / 134)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4) > 285
    kept = sorted((r.draw for r in got), reverse=True)[: sum(r.kept for r in got)]
    assert sorted(r.draw for r in got if r.kept) == sorted(kept)
    assert next(r for r in got if r.doc_id == 900).importance == 0
    assert sum(r.kept for r in resample.resample(docs, labels, k=10).collect()) == 10
    assert all(r.importance == 0 for r in resample.resample(docs, labels.where(F.lit(False)), k=5).collect())
    assert resample.resample(docs.where(F.lit(False)), labels).count() == 0
