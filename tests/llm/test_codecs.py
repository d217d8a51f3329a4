"""Token files, counts and BPE against the libraries, and the pipeline against plain Python."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpipe.llm import bpe, counts, dac
from docpipe.llm.queries import vocabulary
from tests.llm import brute

LETTERS = "abcdefghijklmnopqrstuvwxyzéàöß 0123'!?<|>ÀİΣσ\n\t\x1c\xa0　中文é̈½²ªſǅ▁"
SCHEMA = "doc_id long, text string, token_ids string"


def texts(n=300):
    rng = random.Random(1)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    made += [" ".join("".join(rng.choice("thernoiasdl") for _ in range(rng.randint(1, 12))) for _ in range(k)) for k in (1, 40, 3000)]
    return [*made, None, "", "<|endoftext|> a<|startoftext|>b", "it's I'LL we'Re", "a\nb c\n\nd", " a", "a  b\n", "x" * 9000, "x" * 9000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, None) for i, t in enumerate(texts())], SCHEMA).repartition(3)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_bpe_is_the_librarys(docs):
    t = library("word_bpe_49k.json")
    rows = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    assert len(rows) == len(texts())
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded_text == t.decode(want, skip_special_tokens=False)


def test_bpe_words_need_exact_merging_only_where_a_pair_fails():
    codec = bpe.word_bpe(vocabulary("word_bpe_49k.json"))
    assert codec.sound
    rng = random.Random(2)
    words = [codec.shifted("".join(rng.choice("abcdeinrstohl") for _ in range(rng.randint(1, 25)))) for _ in range(3000)] + [codec.shifted("ab" * 300)]
    assert codec.encode_words(words) == [codec.merged(w) for w in words]


def test_token_files_round_trip(spark, docs):
    t = library("byte_bpe_50k.json")
    manifest = dac.write_tokens(docs, vocabulary("byte_bpe_50k.json"), end_id=2, segment_tokens=3000)
    rows = dac.read_tokens(manifest, dac.crc, "ids_crc32 long").orderBy("start").collect()
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))]
    at = 0
    assert len(rows) == len(want)
    for r, (d, ids) in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = manifest.orderBy("first_token").first()
    segment = dac.open_segment(spark, one.path)
    assert [segment.token(1, k) for k in range(len(want[1][1]))] == want[1][1]
    assert dac.read_tokens(dac.write_tokens(docs.where(F.lit(False)), vocabulary("byte_bpe_50k.json"), 2)).count() == 0


def test_codes_give_any_place():
    values = np.concatenate([np.random.default_rng(1).integers(0, 50257, 5000), [0, 255, 256, 65535, 65536, 1 << 40]])
    for bits in (8, 16):
        codes = dac.Codes.build(values, bits)
        at = np.random.default_rng(2).integers(0, len(values), 2000)
        assert (codes.all() == values).all() and (codes[at] == values[at]).all()
    with pytest.raises(ValueError):
        dac.Segment(b"x" * 100)


def test_counts_are_the_librarys(docs):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for chunk, overlap in ((1 << 15, 1 << 10), (120, 16)):
        for r in counts.count_tokens(docs, vocabulary("piece_bpe_32k.model"), chunk=chunk, overlap=overlap).collect():
            assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(s.encode(r.text or "")))


def test_empty_tables_clashing_names_and_texts_longer_than_a_segment(spark):
    schema = "doc_id long, text string, n_tokens string, path string, content string, Token_Ids int"
    empty = spark.createDataFrame([], schema)
    assert bpe.encode_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0
    assert counts.count_tokens(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert dac.read_tokens(dac.write_tokens(empty, vocabulary("byte_bpe_50k.json"), 2)).count() == 0
    rows = [(4, "long words " * 4000, "n", "p", "c", 1), (None, "x", "n", "p", "c", 1), (4, "long words " * 4000, "n", "p", "c", 1), (5, None, "n", "p", "c", 1)]
    t = library("byte_bpe_50k.json")
    got = dac.read_tokens(dac.write_tokens(spark.createDataFrame(rows, schema), vocabulary("byte_bpe_50k.json"), 2, segment_tokens=100)).orderBy("start").collect()
    assert [(r.doc_id, r.token_ids) for r in got] == [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in ((None, "x"), (4, rows[0][1]), (4, rows[0][1]), (5, None))]
    assert [r.start for r in got] == [0, 2, 2 + got[1].n_tokens, 2 + 2 * got[1].n_tokens]


def test_pipeline_matches_plain_python(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_pairs_urls_leaks import brute_leaks

    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(5)]
    rows = []
    for d in range(160):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 40))) for _ in range(rng.randint(1, 8))]
        if d % 9 == 0:
            lines.append(rng.choice(items)[1])
        if rows and d % 5 == 0:
            lines = [" ".join(rng.choice(words) if rng.random() < 0.02 else w for w in x.split(" ")) for x in rng.choice(rows)[1].split("\n")]
        rows.append((d, "\n".join(lines), "en", f"s{d % 3}"))
    frame = spark.createDataFrame([(*r, len(r[1])) for r in [*rows, (900, None, None, None), (901, "", "en", "s1")] if r[1] is not None] + [(900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    judged = brute.judged([(d, t, s) for d, t, _, s in rows])
    left = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in j[6])) for (d, t, _, _), j in zip(rows, judged, strict=True) if j[7]]
    dups = brute.line_dups(left)
    left = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in sum(dups.get(d, ([], [])), []))) for d, t in left]
    left = [(d, t) for d, t in left if t]
    groups = brute.components(left, 80)
    left = [(d, t) for d, t in left if groups[d][1] == d]
    leaked = {d for d, _ in brute_leaks(left, items)}
    left = [(d, t) for d, t in left if d not in leaked]
    assert set(got) == {d for d, _ in left} and len(leaked) == 5
    t = library("word_bpe_49k.json")
    for d, x in left:
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[d].token_ids == ids and hashlib.sha256(got[d].decoded_text.encode()).digest() == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).digest()
    assert os.path.isdir(f"{tmp_path}/documents.parquet")
