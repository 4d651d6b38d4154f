"""Operators on tables: url rules, mixing, rollups, co-training, the pipeline and the registered queries."""

import pickle
import random
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from flocktrace.llm import cotrain, mixing, queries, rollups, url_alias
from flocktrace.llm.common import new_dir

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, rule string, node int"


def _judge(spark, rows, redirects=None):
    known = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    moved = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_alias.judge(pages, known, moved).collect()}


def test_rules_and_odd_urls(spark):
    rows = [(1, "http://X.Example.NET/en/1?q", ""), (2, "https://example.net/de", None), (3, None, None), (4, "no scheme", ""), (5, "a://b.org/fr/x", ""), (6, "http://notnet/", ""), (7, "http://net", ""), (8, "http://a.example.com/de/", "")]
    assert _judge(spark, rows) == {1: ("x.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.org", "/fr/x", "org/fr/", "allow"), 6: ("notnet", "/", None, "allow"), 7: ("net", "", None, "allow"), 8: ("a.example.com", "/de/", "example.com/de/", "block")}


def test_blocks_reach_aliases_and_allows_win(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [(1, "http://a.io/1", link("http://bad.net/x")), (2, "http://b.io/2", link("/3")), (3, "http://b.io/3", ""), (4, "http://c.io/4", link("http://bad.net/y")), (5, "http://d.io/5", "")]
    got = _judge(spark, rows, [("http://c.io/4", "http://example.net/en/z"), ("http://d.io/5", "http://a.io/1"), (None, "http://a.io/1")])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def _random_pages(seed):
    r = random.Random(seed)
    hosts = ["a.io", "b.io", "x.example.net", "example.net", "w.example.com", "c.org", "bad.net"]
    url = lambda: r.choice(["http", "https"]) + "://" + r.choice(hosts) + r.choice(["", "/", "/en/", "/de/", "/fr/x", "/p/q/", "/p/q/r"]) + r.choice([str(r.randint(0, 25)), f"?i={r.randint(0, 5)}", ""])
    target = lambda: r.choice([url(), url(), f"/{r.randint(0, 25)}", str(r.randint(0, 9)), f"../{r.randint(0, 9)}", f"./x/../{r.randint(0, 9)}", "?i=2", f"//b.io/{r.randint(0, 9)}", "#f", "mailto:a@b", "..", "/a/./b/../../c"])
    html = lambda: r.choice(["", f'<link rel="canonical" href="{target()}">', f"<LINK href='{target()}' REL='canonical'/>", f'<meta http-equiv="refresh" content="5; url={target()}">', None, '<link rel=canonical><link rel="canonical" href="/z">'])
    return [(i, r.choice([url(), url(), url(), url(), None, "nope", "http:///x"]), html()) for i in range(300)]


@pytest.mark.parametrize("seed", [5, 6])
def test_random_links_equal_their_sql(spark, seed):
    import duckdb
    import pandas as pd

    rows = _random_pages(seed)
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    con.execute("CREATE TABLE pages AS SELECT * FROM frame")
    known = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    assert oracle.differences(url_alias.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), known), con, queries.ORACLE_SQL["op1_url_alias"]) == []


def test_verdicts_equal_union_find(spark):
    from urllib.parse import urljoin, urlsplit

    rows, parent = _random_pages(7), {}
    node = lambda u: (lambda s: s.netloc.lower() + (s.path or "/") + (f"?{s.query}" if s.query else ""))(urlsplit(u))

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    r, edges = random.Random(8), []
    urls = [u for _, u, _ in rows if u and "://" in u and urlsplit(u).netloc]
    for _ in range(120):
        page, target = r.choice(urls), r.choice([r.choice(urls), "../y", "z", "/en/q", "http://example.net/en/7"])
        edges.append((page, target))
        parent[find(node(page))] = find(node(urljoin(page, target)))

    def rule(host, path):
        fits = [(len(h + p), a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    decided = {}
    for _, u, _ in rows:
        if u in urls:
            decided[node(u)] = rule(urlsplit(u).netloc.lower(), urlsplit(u).path)
    for n in parent:
        decided.setdefault(n, rule(n.split("/")[0], "/" + n.split("/", 1)[1].split("?")[0]))
    in_class = {}
    for n, a in decided.items():
        in_class.setdefault(find(n), set()).add(a)
    pages = [(i, u, "") for i, u, _ in rows if u in urls]
    moved = spark.createDataFrame(edges, "url string, target string").select("url", url_alias.resolved(F.col("url"), F.col("target")).alias("target"))
    known = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    got = {x.page_id: x.verdict for x in url_alias.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), known, moved).collect()}
    for i, u, _ in pages:
        own, others = rule(urlsplit(u).netloc.lower(), urlsplit(u).path), in_class[find(node(u))]
        assert got[i] == (own or ("block" if "block" in others and "allow" not in others else "allow")), u


def test_equally_long_rules_allow(spark):
    rules = spark.createDataFrame([("b.io", "/xx", "block"), ("a.b.io", "/", "allow")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.b.io/xxy", "")], "page_id long, url string, html string")
    assert [(r.rule, r.verdict) for r in url_alias.judge(pages, rules).collect()] == [("a.b.io/", "allow")]


def test_no_pages(spark):
    assert _judge(spark, []) == {}


def _filled(sizes, weights, share=1.5, most=2.0):
    left, budget, out = dict(sizes), share * sum(sizes.values()), {}
    while left:
        total = sum(weights[s] for s in left)
        over = [s for s in left if budget * weights[s] / total >= most * left[s]]
        if not over:
            return out | {s: budget * weights[s] / total for s in left}
        for s in over:
            out[s] = most * left.pop(s)
        budget = share * sum(sizes.values()) - sum(out.values())
    return out


def test_targets_equal_resharing(spark):
    r = random.Random(6)
    sizes = {f"s{i:02}": r.choice([0, 1, 5, 40, 900, 5000]) for i in range(23)}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = _filled({s: v for s, v in sizes.items() if v}, weights)
    assert got == pytest.approx(want | {s: 0.0 for s in sizes if s not in want})


def test_mix_takes_epochs_then_a_part(spark):
    r = random.Random(7)
    rows = [(i, None if i == 3 else " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["a", "b", None]), 5) for i in range(300)] + [(7, "same", "a", 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert len(got) == 302 and sorted(map(repr, got)) == sorted(map(repr, again))
    by = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        by.setdefault(x.source, []).append(x)
    for rows in by.values():
        assert sum(x.size for x in rows) == rows[0].source_size and abs(sum(x.taken for x in rows) - rows[0].target) < 1
    whole = mixing.mix(df, whole=True).collect()
    assert all(x.size == 0 or x.taken % x.size == 0 for x in whole)


def test_mix_equals_keys_in_order(spark):
    """What each document gives, from keys worked out one by one."""
    import math

    r = random.Random(17)
    rows = [(i if r.random() < 0.9 else None, " ".join(r.choice(["w", "#", "word"]) for _ in range(r.randint(0, 30))), r.choice(["a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tie = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(0))
    drawn = df.select("doc_id", "text", "source", F.coalesce(F.xxhash64("doc_id", F.lit(0)), F.lit(0)).alias("h"), tie.alias("tie"), mixing.quality(F.col("text")).alias("w")).collect()
    of = {}
    for x in drawn:
        u = (((x.tie if x.doc_id is None else x.h) & (1 << 64) - 1) >> 11) + 0.5
        key = -math.log(u / (1 << 53)) / x.w
        of.setdefault(x.source, []).append(((key, x.doc_id is None, x.doc_id or 0, x.tie), x.doc_id, len(x.text.split())))
    sizes = {s: sum(n for _, _, n in v) for s, v in of.items()}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    wanted = []
    for source, target in _filled(sizes, weights).items():
        whole = int(target // sizes[source])
        left = int(target) - whole * sizes[source]
        for _, i, n in sorted(of[source]):
            part = max(0, min(n, left))
            left -= n
            wanted.append((repr(i), str(source), n, whole * n + part))
    got = [(repr(x.doc_id), str(x.source), x.size, x.taken) for x in mixing.mix(df.repartition(5)).collect()]
    assert sorted(got) == sorted(wanted)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_batches_commit_once(spark):
    root = new_dir(spark, "rollups")
    changes = lambda rows: spark.createDataFrame(rows, "source string, lang string, version string, before long, after long, documents string")
    load = changes([("a", "en", "v", None, 10, ""), ("a", "en", "v", None, 5, ""), (None, None, "v", None, 1, "")])
    assert rollups.commit(root, "one", load) and not rollups.commit(root, "one", load)
    assert rollups.commit(root, "two", changes([("a", "en", "v", 10, None, ""), ("a", "en", "v", 5, 7, ""), (None, None, "v", 1, None, ""), ("b", "en", "v", None, None, "")]))
    assert [tuple(r) for r in rollups.totals(spark, root).collect()] == [("a", "en", "v", 1, 7)]
    assert rollups.totals(spark, new_dir(spark, "none")).count() == 0
    with pytest.raises(ValueError):
        rollups.commit(root, "a/b", load)


def test_cotraining_on_held_out_labels(spark):
    r = random.Random(8)
    rows, good = [], {}
    for i in range(600):
        good[i] = int(r.random() < 0.7)
        words = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(50)]
        rows.append((i, " ".join(words) if good[i] else " ".join(w.upper() + "!!" for w in words), "en", "s", 0.5))
    rows += [(600, None, None, None, 0.5), (600, "", "en", "s", 0.5), (None, "x", "en", "s", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, good[i]) for i in range(200)] + [(None, 0), (201, None)], "doc_id long, quality int")
    out = cotrain.score(df, cotrain.fit(df, labels)).collect()
    assert len(out) == 603 and all(0 <= x.p_text <= 1 and 0 <= x.p_meta <= 1 and 0 <= x.score <= 1 for x in out)
    right = [x.kept == bool(good[x.doc_id]) for x in out if x.doc_id is not None and 200 < x.doc_id < 600]
    assert sum(right) / len(right) > 0.98
    assert cotrain.score(df.limit(0), cotrain.fit(df, labels.limit(0))).count() == 0


def test_cotraining_takes_the_surest_of_all_unlabelled(spark):
    r = random.Random(9)
    n = 5000
    rows = [(i, " ".join(("good" if r.random() < i / n else "BAD!") for _ in range(12)), "en", "s") for i in range(n)]
    rows += [(7, rows[7][1], "en", "s"), (None, "good", "en", "s"), (n, "good", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    known = spark.createDataFrame([(n, 1)], "doc_id long, y int")
    table = cotrain._blocks(docs, known, "doc_id", "text", "lang", "source")
    edges = [np.array([0.5])] * len(cotrain._NUMBERS)
    pool = cotrain.Pool(table, edges, sure=0.6)
    assert pool.size == n
    width = cotrain.WORD_BUCKETS + cotrain.SHAPE_BUCKETS
    blocks = [pickle.loads(x.block) for x in table.collect()]
    weights = np.random.default_rng(3).normal(size=width)
    text, meta = cotrain.Logistic(width, weights), cotrain.Logistic(len(edges) * cotrain.BINS + 2 * cotrain._NAMES)
    meta.weights = np.zeros(meta.width)
    z = {int(h): x for b in blocks for h, x in zip(b[0], text.logit(*cotrain._block_rows(b, edges)["text"]), strict=True)}
    order = sorted(z, key=lambda h: (round((z[h] + 30) * (1 << 20)), h >> 26))
    surest = sorted(z, key=lambda h: (-round((z[h] + 30) * (1 << 20)), h >> 26))
    cut = np.log(0.6 / 0.4)
    bad, good = [h for h in order if z[h] <= -cut], [h for h in surest if z[h] >= cut]
    assert len(bad) > 400 or len(good) > 400
    pool.take({"text": text, "meta": meta}, 150, 100)
    pool.take({"text": text, "meta": meta}, 150, 100)
    wanted = dict.fromkeys(bad[:300], 0) | dict.fromkeys(good[:200], 1)
    got = {int(h): int(y) for b in blocks for h, y in zip(b[0], cotrain._handed(b, cotrain._block_rows(b, edges), pool.turns, 0.6)["meta"], strict=True) if y >= 0}
    assert got == wanted and pool.counts == {"text": (0, 0), "meta": (len(good[:200]), len(wanted))}
    # sums made in executors are those of all handed rows at once
    at = [np.array([i for i, h in enumerate(b[0]) if int(h) in wanted], dtype=np.int64) for b in blocks]
    whole = sum(meta.slope(*cotrain._block_rows(b, edges, i)["meta"], np.array([wanted[int(h)] for h in b[0][i]], dtype=float), (0.1, 0.2)) for b, i in zip(blocks, at, strict=True))
    assert np.allclose(pool.slopes({"text": text, "meta": meta}, {"text": (0.1, 0.2), "meta": (0.1, 0.2)})["meta"], whole)
    pool.close()


def test_weights_of_views_equal_a_plain_fit():
    r = np.random.default_rng(4)
    y = (r.random(800) < 0.6).astype(float)
    by_text, by_meta = 3 * (y - 0.5) + r.normal(size=800), r.normal(size=800)
    model = cotrain.Model(None, None, [], 0.4)
    model.weigh(by_text, by_meta, y)
    rows, w = np.stack([by_text, by_meta, np.ones(800)], 1), np.zeros(3)
    for _ in range(20000):
        w -= 0.002 * (rows.T @ (1 / (1 + np.exp(-rows @ w)) - y) + w - np.array([1, 1, -0.4]))
    w[1] = max(w[1], 0)
    assert np.allclose(model.both, w, atol=0.05)
    held = model.together(by_text, by_meta)
    assert abs((1 / (1 + np.exp(-held))).mean() - y.mean()) < 0.03


needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name]) == []


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"pipeline", "op9_fingerprints"}))
def test_query_gives_a_row_for_each_document(spark, name):
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == ids


@needs_tables
def test_cotraining_scores_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").where("quality is not null")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    known = labels.where("doc_id % 3 <> 0")
    judged = cotrain.score(docs, cotrain.fit(docs, known)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in judged) / len(judged) > 0.75


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


@needs_tables
def test_pipeline_takes_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(None, "x y z " * 30, "en", "a", 1), (1, None, None, None, None), (1, "", "en", "a", 0), (2, "x y z " * 30, "en", "a", 1), (2, "x y z " * 30, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).count()
