"""URL filters and neighbours; registration."""

import numpy as np
import pytest

from cubeloom.llm import ann, queries, url_filter

URLS = [
    "http://example.org/es/x", "https://EXAMPLE.org/en/12?q#f", "http://a.b.example.org/en/2", "http://other.org", "http://other.org/", "http://sub.com/fr/a", "ftp://x.com/de/", "x.com/de/", None, "",
    "http://com/fr/", "http://notexample.org/es/", "a://b://c.org/d", "http://É.org/x", "http://x.org?/es/", "http://example.org:80/es/", "http://.org/", "http://example.org/es",
]
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    best = None
    for r in RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best)):
            best = r
    return host, path, best, RULES[best] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    assert {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_by_join(pages, rules).collect()} == got
    assert url_filter.judge(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "http://x.org/"), (None, "http://x.org/")], "page_id long, url string")
    assert url_filter.judge(twice).count() == 2


def test_large_rule_sets_are_joined(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_IMAGE_BYTES", 10)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()} == {i: judge(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_judge_alike(spark, seed):
    """Repeated rules, verdicts of any text, hosts and paths of any length."""
    import random

    rng = random.Random(seed)
    label = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    rules = [(host().upper() if i % 5 == 0 else host(), "/" + label() * rng.randint(0, 2), rng.choice(["allow", "block", "re\nview", "é"])) for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://{host()}/{label()}{label()}?x") for i in range(200)] + [(200, "http://" + "a." * 20000 + "b/" + "a" * 30000)], "page_id long, url string")
    most = {}
    for h, p, v in rules:
        most[h.lower(), p] = max(v, most.get((h.lower(), p), v))
    image = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules, "none").collect()}
    joined = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "none").collect()}
    assert image == joined
    for host_, path, rule, verdict in image.values():
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in most.items() if (host_ == h or host_.endswith("." + h)) and path.startswith(p)]
        assert (rule, verdict) == (max(fits)[2:] if fits else (None, "none"))


def test_equal_digests_are_told_apart_by_their_strings(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b))
    index = url_filter.DigestArray(url_filter.image([("aa", "/", "block"), ("bb", "/", "allow"), ("c", "/dd", "block")]))
    found = index.probe(["aa/", "bb/", "cc/", "c/dd", "c/d", "c/dd"], [2, 2, 2, 1, 1, 2])
    assert [None if i < 0 else index.string(i) for i in found] == [b"aa/", b"bb/", None, b"c/dd", None, None]


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert tuple(url_filter.judge(pages, []).first())[3:] == (None, "allow")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.4).astype(np.float32)
    x[100:400] = x[100]  # many copies
    return x


def exact(x, i, k=10):
    d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
    d[i] = np.inf
    best = np.lexsort((np.arange(len(x)), d))[:k]
    return [(int(j), float(d[j])) for j in best]


def test_recall_and_order(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = ann.neighbours(frame, frame.where("vec_id % 50 = 0"), shard=800).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, found in by.items():
        found.sort()
        want = exact(vectors, q)
        assert [n for n, *_ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        for _, v, s in found:
            assert abs(s - np.sqrt(((vectors[v].astype(float) - vectors[q].astype(float)) ** 2).sum())) < 1e-9
        hit += len({v for _, v, _ in found} & {v for v, _ in want})
    assert len(by) == 60 and hit / 600 >= 0.95
    assert [v for _, v, _ in by[150]] == [v for v, _ in exact(vectors, 150)]  # within the copies: the smallest ids


def test_repeated_ids_are_listed_once(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)).round(3)
    rows = [(i // 2, v.tolist(), "extra") for i, v in enumerate(x)] + [(0, x[0].tolist(), "extra")]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>, score string")
    got = ann.neighbours(frame, frame.where("vec_id < 5")).collect()
    for q in range(5):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        asks = min((x[2 * q], x[2 * q + 1]), key=lambda v: v.astype("<f8").tobytes())
        want = sorted((min(np.sqrt(((x[2 * i + j] - asks) ** 2).sum()) for j in (0, 1)), i) for i in range(20) if i != q)[:10]
        assert [(v, s) for _, v, s in mine] == [(i, s) for s, i in want] and [r for r, *_ in mine] == list(range(1, 11))


def test_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[:100] *= 1e25
    x[100:200] *= 1e-30
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = ann.neighbours(frame, frame.where("vec_id % 10 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(by) == 30 and all(len(v) == 10 for v in by.values())
    assert sum(len(by[q] & {v for v, _ in exact(x, q)}) for q in range(0, 100, 10)) >= 90


def test_queries_in_blocks_give_the_same(spark, vectors, monkeypatch):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:600])], "vec_id long, vector array<float>")
    run = lambda: sorted(map(tuple, ann.neighbours(frame, frame.where("vec_id % 20 = 0"), shard=150).collect()))
    whole = run()
    monkeypatch.setattr(ann, "QUERY_BYTES", 2000)
    assert run() == whole


def test_bad_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, nan]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 2.5]), (6, [1.0]), (None, [1.0, 2.0]), (7, []), (8, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = [tuple(r) for r in ann.neighbours(frame, frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 0.5), (5, 1, 0, 0.5)]
    assert ann.neighbours(frame.limit(0), frame.limit(0)).count() == 0


def test_all_are_registered():
    names = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    import __spark_entry__ as entry

    assert {*names, "pipeline"} <= entry.queries().keys() and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    rel = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == want
