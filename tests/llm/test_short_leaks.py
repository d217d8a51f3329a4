from docpipe.llm import decontaminate
from tests.llm.test_pairs_urls_leaks import SCHEMA, brute_leaks


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "春天来了,花园里的树木都长出了新的叶子"
    items = [(1, "Seven short words make up this item"), (2, "what now"), (3, chinese), (4, "ภาษาไทย"), (5, "..."), (6, "Answer")]
    docs = [
        (1, "so: seven short words make up this item."),
        (2, "seven short words made up this item"),
        (3, "What, now?"),
        (4, "what is now"),
        (5, "昨天" + chinese.replace("树", "草") + "。我们很高兴"),
        (6, "我们很高兴"),
        (7, "เรียนภาษาไทยทุกวัน"),
        (8, None),
        (9, "what"),
        (10, "now the answer"),
    ]
    frame = spark.createDataFrame([(*d, "k") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (3, 2), (5, 3), (7, 4), (10, 6)}
    assert brute_leaks(docs, [x for x in items if x[0] != 1]) == want - {(1, 1)}
    for size in (2_000_000, 10):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench, block_words=size).collect()} == want
        assert {r.doc_id for r in decontaminate.clean(frame, bench, block_words=size).collect()} == {2, 4, 6, 8, 9}
