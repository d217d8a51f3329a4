"""Extra columns named like outputs or like what operators use inside."""

from pyspark.sql import functions as F

from docpipe.llm import bpe, counts, decontaminate, lines, minhash, names, quality, resample, sharding, urls
from docpipe.llm.queries import URL_RULES, vocabulary

EXTRA = ["_t1", "_key", "_bits", "_gone", "exact", "Kept", "Shard", "n_Tokens", "Token_IDs", "part", "bucket", "key", "_fixed", "line", "component_id"]


def test_prefix():
    assert names.free_prefix(["a", "_b", "__C"]) == "___" and names.others(["A", "b"], ["a"]) == ["b"]


def test_operators_take_any_extra_columns(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, None, None)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in EXTRA])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    made = {
        "judge": quality.judge(docs, min_words=1),
        "cleaned": quality.cleaned(docs, min_words=1),
        "lines": lines.dedup(docs),
        "near": minhash.dedup(docs),
        "clean": decontaminate.clean(docs, bench),
        "leaks": decontaminate.find_leaks(docs, bench),
        "shards": sharding.assign(docs, shards=2),
        "resample": resample.resample(docs, labels),
        "bpe": bpe.encode_documents(docs, vocabulary("word_bpe_49k.json")),
        "counts": counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")),
    }
    sizes = {k: len(df.collect()) for k, df in made.items()}
    assert sizes == {"judge": 3, "cleaned": 2, "lines": 3, "near": 2, "clean": 1, "leaks": 2, "shards": 3, "resample": 3, "bpe": 3, "counts": 3}
    for k in ("cleaned", "lines", "near", "clean"):
        assert made[k].columns == docs.columns
    for df in made.values():
        assert len({c.lower() for c in df.columns}) == len(df.columns)
    pages = spark.createDataFrame([(1, "http://a.net/es/x")], "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in EXTRA])
    assert urls.judge(pages, labels, URL_RULES).first().verdict == "block"
