import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_pairs_urls_leaks import SCHEMA, near_corpus
from tests.llm.test_quality_lines_shards import SCHEMA as LINE_SCHEMA, corpus


def test_near_dedup_takes_out_pairs_from_80_percent(spark):
    words = [f"p{i}" for i in range(64)]
    rows = near_corpus(5) + [(900, " ".join(words), "k"), (901, " ".join([*words[:31], "other", *words[31:]]), "k")]
    at = {p: {d for d, (_, c) in brute.components([r[:2] for r in rows], percent=p).items() if c == d} for p in (80, 85)}
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == at[80]
    assert len(at[85] - at[80]) > 1


def test_line_dedup_takes_out_short_lines(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    short = [(200 + i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(6)), None, None, None, None) for i in range(30)]
    rows = corpus(7, 60) + short + [(300, "漢字の長い段落です。\nsee all\none two three four five\nfirst line", None, None, None, None), (301, "See  all\n漢字の長い段落です。\none two 3 four five\nlast line", None, None, None, None)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, LINE_SCHEMA), "").collect()}
    gone = brute.line_dups([r[:2] for r in rows])
    want = {}
    for d, t, *_ in rows:
        out = {i for x in gone.get(d, ()) for i in x}
        want[d] = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in out)
    assert got == {d: t for d, t in want.items() if t}
    assert got[301] == "last line"


def test_quality_rules_take_out_boilerplate_of_a_hot_source(spark):
    # 3,000 texts of one source: 101 hold one line and 100 another, both fewer than 5 %.
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{body} {i}" + ("\nsubscribe now" if i < 101 else "") + ("\nread more" if i >= 2900 else ""), "hot", None, None, None) for i in range(3000)]
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, LINE_SCHEMA), "").collect()}
    assert got == {r[0]: r[1].replace("\nsubscribe now", "") for r in rows}


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, _host string, t1 int, EXACT_LINES int"
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body, "en", "s", 0, "k", "h", 1, 2), (2, body.replace("w59", "w60"), "en", "s", 0, "k", "h", 1, 2), (3, None, None, None, None, None, None, None, None), (3, "", None, None, None, None, None, None, None), (4, " ".join(f"v{i}" for i in range(80_000)), "en", None, 5, "k", "h", 1, 2)]
    full, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        got = stage(spark, full, str(tmp_path))
        if name != "tokens":
            assert sorted(got.columns) == sorted(full.columns)
        want = {"quality_rules": [1, 2, 4], "line_dedup": [1, 4], "near_dedup": [1, 3, 3, 4]}.get(name, [1, 2, 3, 3, 4])
        assert sorted(r.doc_id for r in got.collect()) == want, name
