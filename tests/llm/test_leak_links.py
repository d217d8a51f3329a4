"""Every item that a document holds is named, also where items share a passage."""

import random

import pytest

from docpipe.llm import decontaminate, queries
from tests.llm.test_pairs_urls_leaks import SCHEMA, brute_classes, plain_words


def brute_links(docs, items):
    """{(document, item): (equal words, first word)} of the first of the best windows."""
    out = {}
    for d, t in docs:
        w = plain_words(t)
        for i, x in items:
            v = plain_words(x)
            k = min(13, len(v))
            least = k - (2 * k // 13 if len(v) >= 9 else 0)
            found = [(sum(a == b for a, b in zip(w[p : p + k], v[q : q + k], strict=True)), -p) for p in range(len(w) - k + 1) for q in range(len(v) - k + 1)] if k else []
            if found and max(found)[0] >= least:
                n, p = max([*found, (out[d, i][0], -out[d, i][1])] if (d, i) in out else found)
                out[d, i] = n, -p
    return out


def cases(seed=5):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = some(20)
    items = [(i, f"{some(25)} {shared} {some(25)}") for i in range(10, 20)]
    items += [(30, items[3][1].upper()), (40, "ha " * 30), (41, "ha " * 20 + "ho"), (50, "v1 v2 v3"), (60, some(10))]
    docs = [(i, items[i][1][:90]) for i in range(10)]
    docs += [(20 + i, f"{some(30)} {' '.join(items[i][1].split(' ')[50:])} {some(5)}") for i in range(10)]
    docs += [(40, shared), (41, f"{shared} {some(9)} {' '.join(items[2][1].split(' ')[:20])}"), (42, "ha " * 70), (43, "x v1 v2 v3 v1 v2 v3"), (44, items[-1][1].replace("v", "V", 1)), (45, None), (46, some(40))]
    return docs, items


def test_links_of_items_that_share_a_passage(spark, tmp_path):
    docs, items = cases()
    want, classes = brute_links(docs, items), brute_classes(items)
    assert {classes[i] for i in range(10, 20)} == {10} and {i for d, i in want if d == 5} == {15}
    want_different = {k: v for k, v in want.items() if k[1] != 30}
    docs_frame = spark.createDataFrame([(*d, "k") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 150):
        got = decontaminate.find_leaks(docs_frame, bench, block_words=size).collect()
        assert {(r.doc_id, x.item_id): (x.n_equal, x.first_word) for r in got for x in r["items"]} == want_different
        assert sum(len(r["items"]) for r in got) == len(want_different)
        for r in got:
            assert {classes[x.item_id] for x in r["items"]} == {r.item_id}
            assert (r.n_equal, -r.first_word) == max((x.n_equal, -x.first_word) for x in r["items"])
    same = {r.item_id: r.same_as for r in decontaminate.item_classes(bench).collect()}
    assert same == {i: 13 if i == 30 else i for i in [*range(10, 20), 30, 40, 41]}
    docs_frame.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op5_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id): (r.n_equal, r.first_word) for r in got} == want_different and len(got) == len(want_different)
    assert all(r.class_id == classes[r.item_id] for r in got)


def test_links_of_repeated_item_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(14)) for x in "ab")
    bench = spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (9, b), (9, a), (9, a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a, "k"), (2, b, "k"), (None, b, "k"), (2, b, "k"), (3, f"{a} {b}", "k")], SCHEMA)
    assert {r.item_id: r.same_as for r in decontaminate.item_classes(bench).collect()} == {5: 5, 7: 7, 8: 8, 9: 5}
    for size in (2_000_000, 20):
        got = decontaminate.find_leaks(docs, bench, block_words=size).collect()
        assert sorted((r.doc_id or 0, [x.item_id for x in r["items"]]) for r in got) == [(0, [5, 8]), (1, [5, 7]), (2, [5, 8]), (2, [5, 8]), (3, [5, 7, 8])]


@pytest.mark.parametrize("most", [1, 7, 60, 500_000])
def test_search_in_portions(monkeypatch, most):
    monkeypatch.setattr(decontaminate, "_EXPANDED", most)
    for seed in (5, 6):
        docs, items = cases(seed)
        got = {}
        for found in decontaminate.Seeds(items).search([t for _, t in docs]):
            for text, _, item, equal, first in zip(*(x.tolist() for x in found), strict=True):
                assert (docs[text][0], item) not in got
                got[docs[text][0], item] = equal, first
        assert got == brute_links(docs, items)
