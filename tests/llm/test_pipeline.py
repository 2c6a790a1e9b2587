"""The pipeline's stages, each against the rows of the one before."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0, name
        if name == "near_duplicates":
            assert after.count() == after.select("doc_id").distinct().count() < before.count()
        before = after
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == before.where("text is not null").select("doc_id").distinct().count()


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, an empty text, repeated rows and extra columns with names that the stages use."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "a"), (1, words, "a"), (2, words, None), (3, None, "b"), (4, "", "b"), (None, "a text without an id", "b"), (None, None, None), (5, "other words here for a short text", "c")]
    schema = "doc_id bigint, text string, source string, lang string, copies int, n bigint, component_id bigint"
    odd = spark.createDataFrame([(i, t, s, "en", 7, 8, 9) for i, t, s in rows], schema)
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["near_duplicates"](spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5]
    taken = stage["mixing"](spark, odd, SF)
    assert taken.columns == odd.columns
    got = [r["doc_id"] for r in taken.collect()]
    assert got.count(None) == 2 and got.count(1) <= 4 and got.count(2) <= 2
    assert stage["packing"](spark, odd, SF).agg({"length": "sum"}).first()[0] > 0
    for name in ("toxicity", "quality", "near_duplicates", "mixing"):
        assert stage[name](spark, odd.limit(0), SF).count() == 0, name
    for name in ("toxicity", "quality"):
        assert stage[name](spark, odd, SF).columns == odd.columns


def test_near_duplicates_by_row(spark):
    """One row of each group of like texts stays, with repeated ids and without any, as brute force has it."""
    words = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(7, words(f"t{i}")) for i in range(20)] + [(3, words("t4") + " end"), (9, words("t5")), (None, words("t6"))]
    rows += [(None, words("copied"))] * 30 + [(None, words("alone")), (None, ""), (None, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string").repartition(5)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns
    sets = [frozenset(tuple((t or "").split()[j : j + 5]) for j in range(max(0, len((t or "").split()) - 4))) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, (i, t) in zip(group, rows):
        own = (i is None, i or 0, t or "")
        best[g] = min(best.get(g, own), own)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted(best.values())


def test_nulls_in_every_column(spark):
    """Rows that differ only in which columns are null stay apart in mixing; near duplicates keep one of each text."""
    from collections import Counter

    texts = ["a b c", "d e f g h i j", None]
    rows = [(i, t, lang, source, n) for i in (1, 2, None) for t in texts for lang, source in ((None, "web"), ("web", None), (None, None)) for n in (None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(corpus_pipeline.STAGES)
    kept = Counter(map(tuple, stage["near_duplicates"](spark, docs, SF).collect()))
    worded = Counter({r: n for r, n in kept.items() if r[1]})
    assert Counter(r for r in rows if not r[1]) == kept - worded  # texts without words are like no other
    assert sorted((r[0], r[1]) for r in worded.elements()) == [(1, "a b c"), (1, "d e f g h i j")] and set(worded) <= set(rows)
    mixed = Counter(map(tuple, stage["mixing"](spark, docs, SF).collect()))
    assert set(mixed) <= set(rows) and all(mixed[r] == 1 for r in rows if r[0] is None)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split()) if r[0] else 0
    got = Counter()
    for r, n in mixed.items():
        got[r[3]] += len((r[1] or "").split()) * n if r[0] else 0
    # two sources weigh 3 and 1 and share 150 % of all words, at most twice their own
    budget = 1.5 * sum(size.values())
    web = min(2 * size["web"], budget * 3 / 4)
    assert abs(got["web"] - web) <= 7 and abs(got[None] - min(2 * size[None], budget - web)) <= 7
    assert all(1 <= mixed[r] <= 2 for r in rows if r[0] and r[1] and r[3] == "web")  # more than a whole epoch
    assert all(n <= 2 for n in mixed.values())
