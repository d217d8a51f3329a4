"""The registered queries over a small table, by their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docpipe.llm import queries
from docpipe.llm.queries import vocabulary
from tests.llm import brute

WORDS = ["The", "of", "é", "$", *[f"w{i}" for i in range(150)]]


def texts():
    rng = random.Random(9)
    made = ["\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    made += [made[3], made[5] + " more", None, "", " \n\t", "one two", "a b " * 3000, "x" * 5000]
    return list(enumerate(made))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, texts()[7][1]), (2, None), (3, "never seen at all")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    urls = ["https://a.com/x", "http://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "https://b.net/es/", "https://b.net/de/", "c.com/en", None, "http://net/fr/#x"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def rows(spark, folder, name, types):
    df = queries.QUERIES[name](spark, folder)
    assert df.dtypes[: len(types)] == types
    return df.collect()


def test_near_duplicates(spark, folder):
    got = rows(spark, folder, "op1_near_duplicates", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(texts())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_token_files_counts_and_bpe(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    files = {r.doc_id: r for r in rows(spark, folder, "op2_token_files", [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")])}
    counted = {r.doc_id: r for r in rows(spark, folder, "op7_token_counts", [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")])}
    coded = {r.doc_id: r for r in rows(spark, folder, "op9_bpe_round_trip", [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])}
    byte, word = (Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    piece, start = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), 0
    assert len(files) == len(counted) == len(coded) == len(texts())
    for i, t in texts():
        t = t or ""
        ids = byte.encode(t, add_special_tokens=False).ids + [2]
        assert tuple(files[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        n = len(piece.encode(t))
        assert tuple(counted[i])[1:] == (len(t.encode()), n, n > 4096)
        ids = word.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(coded[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    assert any(r.over_limit for r in counted.values())


def test_urls(spark, folder):
    got = rows(spark, folder, "op4_url_filter", [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")])
    assert [tuple(r)[1:5] for r in sorted(got, key=lambda r: r.page_id)] == [
        ("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("b.net", "/es/", "net/es/", "block"),
        ("b.net", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "/fr/", "net/fr/", "block"),
    ]


def test_shards(spark, folder):
    got = rows(spark, folder, "op6_shards", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts()}
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None for r in got)


def test_quality_and_lines(spark, folder):
    got = {r.doc_id: r for r in rows(spark, folder, "op8_quality_rules", [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", "boolean"), ("kept", "boolean")])}
    for (i, _), j in zip(texts(), brute.judged([(i, t, f"s{i % 3}") for i, t in texts()]), strict=True):
        assert tuple(got[i])[1:8] == (*j[:6], j[7])
    want = brute.line_dups(texts())
    for r in queries.op3_line_dedup(spark, folder).collect():
        exact, near = want.get(r.doc_id, ([], []))
        assert (r.exact_lines, r.near_lines) == (",".join(map(str, exact)), ",".join(map(str, near)))


def test_leaks_and_sample(spark, folder):
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, folder).collect()} == {(7, 1)}
    got = queries.op10_resampling(spark, folder).collect()
    assert len(got) == len(texts()) and sum(r.kept for r in got) == round(len(got) * 0)
    assert re.fullmatch(r"op\d+_\w+", min(queries.QUERIES)) and len(queries.QUERIES) == 10
