import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docpipe.llm import lines, quality, sharding
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, extra string, kept string, shard string"


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    boiler = " ".join(rng.choice(words) for _ in range(12))
    made = []
    for d in range(n):
        ls = []
        for _ in range(rng.randint(0, 8)):
            k = rng.random()
            if k < 0.25:
                ls.append(boiler)
            elif k < 0.6 and made:
                x = rng.choice(made).split(" ")
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], [*x[:i], "new", *x[i + 1 :]], [*x[:i], "more", *x[i:]], x, x[::-1]])
                ls.append(" ".join(x))
            else:
                ls.append(rng.choice(["", " ", "\t"]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
            if ls[-1].strip():
                made.append(ls[-1])
        text = rng.choice([None, "", " \n "]) if rng.random() < 0.06 else "\n".join(ls)
        made += [] if text else []
        made = made[-200:]
        made_text = text
        if d and rng.random() < 0.1:
            made_text = rows[-1][1]
        rows = (rows if d else []) + [(d, made_text, rng.choice(["a", "b", None]), "x", "y", "z")]
    return rows


def test_quality_matches_brute_force(spark):
    rows = corpus(1) + [(7, "A b c. " * 40, "a", None, None, None), (None, "é# $x\n" * 3, None, None, None, None)]
    rows += [(400 + i, "the same footer\n" + "w " * 60, "mirror", None, None, None) for i in range(6)]  # copies count
    rows += [(500, "one page\n" + "w " * 60, "again", None, None, None)] * 6  # rows of one document don't
    rows += [(600 + i, f"{i} long\n" + "menu\n" * (i < 9), "big", None, None, None) for i in range(200)]  # the share lets it stay, the number doesn't
    rows += [(900, "x " * 200_000 + "\n" + "menu\n" * 50_000, "big", None, None, None)]
    cols = ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "kept"]
    for most, few in ((None, 4000), (8, 4000), (8, 0)):
        got = quality.judge(spark.createDataFrame(rows, SCHEMA), line_min_docs=3, line_max_share=0.1, line_max_texts=most, few=few)
        assert got.columns.count("kept") == 1 and "extra" in got.columns
        found = brute.judged([r[:3] for r in rows], 3, 0.1, line_max_texts=most or 10**9)
        want = Counter((r[0], r[1], *w[:6], tuple(w[6]), w[7]) for r, w in zip(rows, found, strict=True))
        have = Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got.select(cols).collect())
        assert have == want
        lost = {r[0]: r[8] for r in have}
        assert lost[400] and not lost[500] and bool(lost[600]) == (most == 8)


def test_quality_empty_table_and_cleaned(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame(corpus(2), SCHEMA)
    assert quality.cleaned(docs, line_min_docs=3).columns == docs.columns


def test_lines_match_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed) + [(None, "null id line with enough words to count here", "a", None, None, None)]
        got = lines.mark(spark.createDataFrame(rows, SCHEMA))
        have = {r["doc_id"]: (r["exact_lines"], r["near_lines"]) for r in got.collect() if r["exact_lines"] or r["near_lines"]}
        want = brute.line_dups([r[:2] for r in rows])
        assert have == want
        assert sum(len(x[1]) for x in want.values()) > 20


def test_lines_text_and_edges(spark):
    long = "one two three four five six seven eight nine"
    rows = [(1, long + "\nshort line", "a", "", "", ""), (2, "keep\n" + long.upper() + "\n" + long.replace("four", "4"), "a", "", "", ""), (3, None, "a", "", "", ""), (1, long + "\nshort line", "a", "", "", "")]
    rows += [(4, "Short  line\nnew\nkeep", "a", "", "", ""), (5, "漢字の長い段落です。\nsee five", "a", "", "", ""), (6, "漢字の短い段落です。\nsee fiv", "a", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, rows[0][1]), (1, rows[0][1]), (2, "keep"), (3, ""), (4, "new"), (5, rows[5][1]), (6, "see fiv")]
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_one_id_with_two_texts(spark):
    rows = [(1, "alpha beta\nfirst", "a", "", "", ""), (1, "alpha beta\nsecond", "a", "", "", ""), (2, "alpha beta", "a", "", "", "")]
    out = lines.dedup(spark.createDataFrame(rows, SCHEMA))
    left = [r.text for r in out.collect()]
    assert sum("alpha beta" in t for t in left) == 1 and sum("first" in t for t in left) == 1 and sum("second" in t for t in left) == 1 and "" in left


def test_lines_of_very_long_texts(spark):
    rows = [(1, "\n".join(f"line {i % 5000} of a long text with words" for i in range(20_000)), "a", "", "", ""), (2, "word " * 50_000 + "\nnew", "a", "", "", ""), (3, "word " * 50_001 + "\nline 7 of a long text with words", "a", "", "", "")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute.line_dups([r[:2] for r in rows[1:]])
    assert want == {3: ([], [0])} and got == {1: "line 0 of a long text with words", 2: rows[1][1], 3: ""}


def test_large_and_small_sets_of_texts_give_the_same_lines(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(8), SCHEMA)
    want = sorted((r.doc_id, r.text or "") for r in lines.dedup(docs).collect())
    monkeypatch.setattr(lines, "_FEW_TEXTS", 0)
    assert sorted((r.doc_id, r.text or "") for r in lines.dedup(docs).collect()) == want


def test_shards(spark):
    rows = corpus(5, 400) + [(None, None, "a", "", "", ""), (3, "dup", "a", "", "", ""), (3, "dup", "a", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.assign(docs, shards=5, groups_in_part=90, fan_in=2, rows_in_part=50).collect()
    assert len(out) == len(rows)
    slots, sums, of_text = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
        of_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sums.values()) - min(sums.values()) <= 40
    assert all(len(x) == 1 for k, x in of_text.items() if k[0])
    assert sharding.assign(docs.where(F.lit(False)), shards=5).count() == 0


def test_differencing_keeps_members():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(300)]
    sets = sharding.difference([[(s, i)] for i, s in enumerate(sizes)], 7)
    assert sorted(i for _, m in sets for i in m) == list(range(300))
    assert all(s == sum(sizes[i] for i in m) for s, m in sets)
    assert sets[-1][0] - sets[0][0] <= 10
