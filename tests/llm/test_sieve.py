from pyspark.sql import functions as F

from docpipe.llm import minhash
from docpipe.llm.storage import ship, sieved


def shuffled_rows(df):
    """Rows that the exchanges of the plan wrote; runs it."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            left.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(plan.plan())
        else:
            if name == "Exchange":
                total += plan.metrics().apply("shuffleRecordsWritten").value()
            left += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_a_sieve_keeps_every_wanted_row(spark):
    df = spark.range(-20_000, 20_000).select(F.col("id").alias("k"), "id")
    wanted = df.where("k % 40 = 0").select((F.col("k") * 1).alias("w"))
    for most, stay in ((1 << 18, 5_000), (20, 32_000)):  # the second has fewer bits than twice the keys
        left = {r.k for r in sieved(df, "k", wanted, "w", most).collect()}
        assert left >= set(range(-20_000, 20_000, 40))
        assert len(left) < stay
    assert sieved(df, "k", wanted.limit(0), "w").count() == 0


def test_texts_that_share_no_bucket_are_not_shuffled(spark):
    rows = [(i, " ".join(f"w{(i * 7919 + k * k * (i + 3)) % 50021}" for k in range(60))) for i in range(3000)]
    rows += [(5000, rows[0][1] + " more")]
    found = []
    for d in (0, 5000):
        s1, s2 = minhash.set_key(minhash.shingle_set(dict(rows)[d]))
        found.append((d, s1, s2, [(7, 0, 0)]))
    tasks = spark.createDataFrame(found, "first_id long, s1 long, s2 long, tasks array<struct<bucket:bigint,x:int,y:int>>")
    ship(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the join that large tables get
    try:
        links = minhash._compared(tasks, spark.createDataFrame(rows, "doc_id long, text string"), 85)
        assert shuffled_rows(links) < 600
        assert [{r.a, r.b} for r in links.collect()] == [{0, 5000}]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
