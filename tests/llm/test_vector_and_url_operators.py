"""The operators on vectors and pages against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm.components import components
from veilmark.llm.queries import RULES, oracle_sql
from veilmark.llm.urlfilter import judge_urls
from veilmark.llm.vafile import top_k
from veilmark.llm.vecdedup import near_vectors

VECTORS = "vec_id long, embedding array<float>, label int, rank string, digest string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], VECTORS)


def clusters(n=600, dims=32, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    x = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, dims)) * rng.choice([0.05, 0.2, 0.35, 1.0], n)[:, None]
    x[n // 2 : n // 2 + 30] = x[0]
    return x.astype(np.float32)


ODD = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] * 32), (9004, [math.inf] * 32), (9005, []), (9006, [1.0, 2.0])]


@pytest.mark.parametrize("block", [64, 4096])
def test_near_vectors(spark, block):
    x = clusters()
    got = {r["vec_id"]: r for r in near_vectors(vectors(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *ODD]), 0.9, block).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(1)
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    comp = np.array([got[i]["component_id"] for i in range(len(x))])
    a, b = np.nonzero(near)
    assert (comp[a] == comp[b]).mean() > 0.99 and all((comp == c).any() and comp[c] == c for c in set(comp.tolist()))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in ODD)


def test_top_k(spark):
    x = clusters(300)
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), (300, x[0].tolist()), *ODD]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()]
    whole = np.floor(256 * np.vstack([x, x[:1]]).astype(np.float64)).astype(np.int64)
    score = whole @ whole.T
    want = []
    for q in range(0, 301, 50):
        best = sorted((-int(s), i) for i, s in enumerate(score[q]) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert top_k(vectors(spark, ODD), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_odd_rows(spark):
    """Null and repeated ids, repeated queries, ties, large components and several lengths, against brute force."""
    rng = np.random.default_rng(6)
    x = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(120)] + [(50, [1.0, 2.0, 3.0, 4.0]), (7, [900.0, -800.0, 5.0, 0.25]), (7, [0.0] * 4), (None, [1.0] * 4), (100, [1.0, 2.0]), (101, [3.0, 4.0])]
    want, whole = [], [(i, [math.floor(256 * v) for v in e]) for i, e in x if i is not None]
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        asked, best = min(e for i, e in whole if i == q), {}
        for i, e in whole:
            if i != q and len(e) == len(asked):
                best[i] = max(best.get(i, -(1 << 62)), sum(a * b for a, b in zip(asked, e)))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:5])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(vectors(spark, x), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_of_very_large_components(spark):
    """Float32 to its end: exact order, scores held to 64 bits; beyond 1e150 a vector takes no part."""
    rng = np.random.default_rng(8)
    x = [(i, [float(v) for v in np.float32(rng.standard_normal(3) * 10.0 ** rng.choice([-3, 0, 9, 18, 30]))]) for i in range(60)]
    x += [(100, [1e18, 1.0, 0.0]), (101, [3.4e38, -3.4e38, 1.0]), (102, [128 / 256, 0.0, 0.0]), (103, [2.0**55, 2.0**55, 0.0]), (150, [1e200, 0.0, 0.0])]
    whole = [(i, [math.floor(256 * v) for v in e]) for i, e in x if i != 150]
    limit, want = 10**38 - 1, []
    for q, asked in whole:
        if q % 50 == 0:
            best = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(asked, e)))), i) for i, e in whole if i != q)[:5]
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
    doubles = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(doubles, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_near_vectors_of_odd_ranges(spark):
    """Squares that vanish or pass a double's range, multiples of one vector, null and repeated ids."""
    x = [(1, [1e-200, 0.0]), (2, [1e-310, 1e-315]), (3, [1e300, 1e300]), (4, [1.0, 1.0]), (5, [2.0, 2.0]), (6, [0.0, 3.0]), (None, [1.0, 1.0]), (4, [1.0, 1.0]), (7, [-1.0, 0.0]), (6, [5.0, 0.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in near_vectors(spark.createDataFrame(x, "vec_id long, embedding array<double>"), 0.9).collect())
    # 1 and 2 lie along the first axis, as does the second row of 6; 3, 4 and 5 along the diagonal
    assert [g for g in got if g[0] in (0, 3, 4, 5, 7)] == [(0, 0, 0), (3, 2, 3), (4, 2, 3), (4, 2, 3), (5, 2, 3), (7, 0, 7)]
    assert all(c == 1 for i, _, c in got if i in (1, 2, 6))


def test_empty(spark):
    none = vectors(spark, ODD[:1]).where("false")
    assert near_vectors(none).count() == top_k(none, F.lit(True)).count() == 0
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500, i) for i in range(501, 560)] + [(600 + i, 601 + i) for i in range(40)] + [(7, None), (8, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


def test_urls(spark):
    """Rules, edges of every form and components, by hand and against the registered SQL."""
    import duckdb
    import pandas as pd

    link = '<html><head><LINK href="{}" rel="x canonical"></head>'
    pages = [
        (1, "http://A.net/x?q=1#f", None),
        (2, "https://example.net/en/a", ""),
        (3, "https://sub.example.net/de/a", ""),
        (4, "http://example.com/de/x", "<p>"),
        (5, "http://notexample.com/de/x", ""),
        (6, "http://plain.io/p", link.format("http://a.net/x")),
        (7, "http://plain.io/p/", ""),
        (8, "http://mixed.io/", link.format("https://example.net/en/other")),
        (9, "http://mixed.io", '<meta http-equiv="refresh" content="0; url=http://blocked.net/y">'),
        (10, None, None),
        (11, "no scheme", None),
        (11, "no scheme", None),
        (12, "http://x.org?/fr/", ""),
        (13, "http://x.org/fr/", ""),
        (14, "https://far.io/a/b?x=1&y=2", link.format("/c")),
        (15, "https://far.io/c", "<link rel='canonical' href='d'>"),
        (16, "http://far.io/d", "<link rel=canonical href=//blocked.net/z>"),
        (17, "http://far.io/e", link.format("http://far.io/a/b?x=1&amp;y=2")),
        (18, "http://far.io/g", link.format("mailto:me@far.io") + link.format("#top") + "<link rel=stylesheet href=/c>"),
        (19, "http://long.io/" + "p" * 5000, "<b>" * 50_000 + link.format("http://blocked.net/q")),
        (None, "http://far.io/d", None),
    ]
    df = spark.createDataFrame([(*p, "own", "own", 7) for p in pages], "page_id long, url string, html string, host string, rule string, alias int")
    rows = judge_urls(df, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3][2:] == ("net/", "block") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "allow")  # an explicit allow goes before a block
    assert got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("x.org", "", None, "allow") and got[13][2] == "org/fr/"
    assert [got[i][2:] for i in (14, 15, 16, 17, 19, None)] == [(None, "block")] * 6 and got[18][2:] == (None, "allow")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.execute(oracle_sql()["op9_url_filters"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in rows)
