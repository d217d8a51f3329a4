import itertools
import random
import re

from pyspark.sql import functions as F

from docpipe.llm import oracles, queries, urls


def test_mining_uses_every_row(spark):
    # 40 hosts with 500 bad urls each, 40 with 900 good and 100 bad ones, and 1.94 million other good urls.
    k, n = F.col("id"), 2_000_000
    host = (
        F.when(k < 20_000, F.concat(F.lit("h:bad"), k % 40))
        .when(k < 60_000, F.concat(F.lit("h:mixed"), k % 40))
        .otherwise(F.concat(F.lit("h:good"), k % 100))
    )
    bad = (k < 20_000) | ((k < 60_000) & (F.floor(k / 40) % 10 == 0))
    labelled = spark.range(n).select(F.array(host, F.lit("p:x")).alias("tokens"), bad.alias("bad"))
    got = {tuple(r.tokens): (r.confidence, round(r.hits)) for r in urls.mine(labelled).collect()}
    assert got == {(f"h:bad{i}",): (1.0, 500) for i in range(40)}


def minimal_rules(rows, min_count, min_confidence, min_lift):
    """rows: (tokens, bad). {tokens: (confidence, hits)} of the rules that no shorter one is part of."""
    share = sum(b for _, b in rows) / len(rows)
    out = {}
    every = sorted({x for t, _ in rows for x in t})
    for size in range(1, len(every) + 1):
        for combo in itertools.combinations(every, size):
            held = [b for t, b in rows if set(combo) <= set(t)]
            if sum(held) >= min_count and sum(held) / len(held) >= min_confidence and sum(held) / len(held) / share >= min_lift and not any(set(x) <= set(combo) for x in out):
                out[combo] = (sum(held) / len(held), sum(held))
    return out


def test_mined_rules_match_brute_force(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = []
        for _ in range(400):
            tokens = [x for x in "abcdefgh" if rng.random() < 0.5] + ["all"]
            rows.append((tokens, rng.random() < (0.9 if {"a", "b", "c"} <= set(tokens) or {"d", "f"} <= set(tokens) and "a" not in tokens else 0.1)))
        want = minimal_rules(rows, 8, 0.8, 1.5)
        got = {tuple(r.tokens): (round(r.confidence, 9), round(r.hits)) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 8, 0.8, 1.5).collect()}
        assert got == {k: (round(c, 9), n) for k, (c, n) in want.items()}
        assert max(map(len, want)) > 2 and len(want) > 1


def test_mining_reaches_the_end_of_long_urls(spark):
    # 30 tokens that all urls share, and two after them that are bad together only.
    shared = [f"p:{i:02}" for i in range(30)]
    rows = [([*shared, *end], len(end) == 2) for end in (["q:x", "q:y"], ["q:x"], ["q:y"], []) for _ in range(25)]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r.tokens, r.confidence, r.hits) for r in got] == [(["q:x", "q:y"], 1.0, 25.0)]


def plain_tokens(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2].lower()) if m else ("", "")
    query = re.search(r"\?([^#]*)", url or "")
    keys = [x.split("=")[0] for x in query[1].split("&")] if query else []
    return {f"h:{x}" for x in host.split(".") if x} | {"p:" + re.sub(r"\d+", "#", x) for x in re.split("[/._-]", path) if x} | {f"q:{x}" for x in keys if x}


def test_mined_rules_judge_thousands_of_urls(spark, tmp_path):
    """With the parameters of the registered query, against brute force and against its SQL."""
    rng = random.Random(8)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "shop", "play") for b in ("alpha", "beta", "lucky", "gamma") for c in ("org", "net", "com")]
    parts, keys = ["news", "bonus", "offer-7", "item", "wiki", "a_b"], ["ref", "page", "win"]
    pages = []
    for i in range(4000):
        path = "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
        pages.append((i, f"https://{rng.choice(hosts)}/{path}" + ("?" + "&".join(f"{rng.choice(keys)}={i}" for _ in range(rng.randint(1, 2))) if rng.random() < 0.5 else "")))
    pages += [(4000, None), (4001, "lucky bonus"), (4002, "https://" + "lucky." * 50 + "org/" + "bonus/" * 2000)]
    tokens = {i: plain_tokens(u) for i, u in pages}
    bad = lambda t: rng.random() < (0.95 if {"h:lucky", "p:bonus"} <= t or {"q:win", "p:offer", "h:play"} <= t else 0.03)
    labels = [(i, int(not bad(tokens[i])), 0) for i, _ in pages[:3000]]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([*labels, (None, 0, 0), (3500, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(tokens[i], q == 0) for i, q, _ in labels if tokens[i]]
    rate, rules = sum(b for _, b in rows) / len(rows), []
    for size in (1, 2, 3):
        for combo in itertools.combinations(sorted(set().union(*tokens.values())), size):
            held = [b for t, b in rows if t.issuperset(combo)] if not any(set(x) <= set(combo) for x in rules) else []
            if sum(held) >= 20 and sum(held) / len(held) >= 0.8 and sum(held) / len(held) / rate >= 2:
                rules.append(combo)
    got = {r.page_id: r for r in queries.op4_url_filter(spark, str(tmp_path)).collect()}
    mined = {i: any(t.issuperset(x) for x in rules) for i, t in tokens.items()}
    assert len(got) == len(pages) and sum(m and got[i].rule is None for i, m in mined.items()) > 200
    for i, r in got.items():
        assert r.verdict == ({"com/": "allow", "net/es/": "block", "net/fr/": "block"}[r.rule] if r.rule else "block" if mined[i] else "allow"), (r, tokens[i])
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(db.sql(oracles.URLS).fetchall()) == sorted(tuple(r) for r in got.values())


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, HOST string, mined int")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    got = urls.judge(none, labels, queries.URL_RULES)
    assert got.count() == 0 and got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "mined"]
