"""The operators on documents against brute-force versions and planted cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import ngramjoin, quality, toxicity
from veilmark.llm.mixing import mix_sources, sized_rows
from veilmark.llm.ngramjoin import jaccard_components
from veilmark.llm.packing import first_fit_decreasing, pack_documents
from veilmark.llm.queries import op5_token_counts
from veilmark.llm.quality import fit_quality, score_quality
from veilmark.llm.sharding import shard_rows
from veilmark.llm.tokencounts import TokenRollup, signed, token_counts
from veilmark.llm.tokens import default_path
from veilmark.llm.toxicity import fit_toxicity, held_out, score_toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component string, shard string, h string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def table(spark, texts):
    """Rows with odd further columns; texts may be (id, text) or (id, text, source)."""
    rows = [(i, t, "en", s[0] if s else "web", None, "own", "own", "own", "own") for i, t, *s in texts]
    return spark.createDataFrame(rows, DOCS)


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(root)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for i in range(n):
        if i % 3 == 0 or not texts:
            body = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
            body = shared + body if i % 2 else body
        else:
            body = list(rng.choice(texts)[1].split())
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                body[rng.randrange(len(body))] = rng.choice(vocabulary)
        texts.append((i, " ".join(body)))
    return texts


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("long_list,block", [(48, 512), (2, 7)])
def test_join_is_whole(spark, monkeypatch, k, percent, long_list, block):
    monkeypatch.setattr(ngramjoin, "LONG_LIST", long_list)
    monkeypatch.setattr(ngramjoin, "LIST_BLOCK", block)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 900 if block == 7 else 400_000)
    texts = [*near_copies(k), (900, None), (901, ""), (902, " \t\n"), (903, "ONE two"), (904, "one\ttwo"), (905, "two one"), (None, "one two"), (None, None)]
    got = jaccard_components(table(spark, texts), k, percent).collect()
    assert len(got) == len(texts)
    want = brute_components(texts, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    by_id = {r["doc_id"]: r["n_shingles"] for r in got}
    assert by_id[900] == by_id[901] == by_id[902] == 0 and by_id[903] == 1


def opposites(doublings):
    """A word of two letters and its opposite, whose polynomial hashes modulo powers of two are equal."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_join_tells_long_words_apart(spark):
    """Words made to clash under polynomial hashes link nothing; a very long text is linked with its near copy."""
    texts = [(10 * n + i, w) for n in (10, 11, 12) for i, w in enumerate(opposites(n))]
    texts += [(10 * n + i + 500, f"{w} one two three four {w}") for n in (10, 11, 12) for i, w in enumerate(opposites(n))]
    long = [f"w{i}" for i in range(40_000)]
    texts += [(900, " ".join(long)), (901, " ".join([*long[:-1], "end"])), (902, "x" * 2_000_000), (903, "x" * 2_000_000)]
    for k, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_components(table(spark, texts), k, percent).collect()}
        assert got == {i: i for i, _ in texts} | {901: 900, 903: 902}


def test_rows_of_one_id_are_one_document(spark):
    """An id whose rows have different texts ties their groups together, and an id without texts is alone."""
    body = [" ".join(f"{name}{i}" for i in range(50)) for name in "abc"]
    texts = [(3, body[0]), (5, body[0]), (5, body[1]), (7, body[1]), (7, body[1]), (8, body[2]), (9, ""), (None, body[0])]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_components(table(spark, texts), 3, 90).collect()]
    assert sorted(got, key=repr) == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (8, 8), (9, 9), (None, None)], key=repr)


def test_mix(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(["x"] * rng.randint(0, 60)), ["a", "b", "c", None][min(3, i % 7)]) for i in range(700)] + [(1000, None, "a"), (1001, "", None)]
    first, again = ({r["doc_id"]: r for r in mix_sources(table(spark, texts)).collect()} for _ in range(2))
    assert {i: r["taken"] for i, r in first.items()} == {i: r["taken"] for i, r in again.items()} and len(first) == len(texts)
    sizes = {}
    for i, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order, open_ = sorted(sizes, key=lambda s: (s is None, s or "")), None
    weight, target, left = {s: [3, 1, 2][j % 3] for j, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    open_ = list(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    for s in order:
        own = [r for r in first.values() if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 60
        assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"] for r in own)


@pytest.mark.parametrize("hot", [7, None])
def test_mix_of_repeated_ids(spark, hot):
    """A third of the rows share an id: no source misses its target by more than a row, and repeats have keys of their own."""
    texts = [(i, "x " * 20, "ab"[i % 2]) for i in range(600)] + [(hot, "x " * 20 if i % 2 else f"y{i} " * 20, "ab"[i % 4 // 2]) for i in range(300)]
    got = mix_sources(table(spark, texts)).collect()
    assert len(got) == len({r["row"] for r in got}) == len(texts)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and own[0]["target"] > 0
    sized = sized_rows(table(spark, texts)).collect()
    assert len({r["u"] for r in sized}) == len(texts)


def test_shards(spark):
    rng = random.Random(3)
    texts = [(i, "same words here" if i % 3 == 0 else "é" * rng.randint(0, 300) + str(i)) for i in range(3000)] + [(9000, None), (9001, ""), (9001, ""), (None, "x")]
    rows = shard_rows(table(spark, texts)).collect()
    assert sorted((r["doc_id"] or -1, r["text_crc32"]) for r in rows) == sorted((i or -1, zlib.crc32((t or "").encode())) for i, t in texts)
    per = [[r for r in rows if r["shard"] == s] for s in range(16)]
    assert all(sorted(r["slot"] for r in p) == list(range(len(p))) for p in per)
    held = [sum(r["size"] for r in p) for p in per]
    assert sum(held) == sum(len((t or "").encode()) + 1 for _, t in texts) and max(held) - min(held) < 0.05 * sum(held) / 16 + 1300


@pytest.mark.parametrize("hot", [7, None])
def test_shards_divide_repeated_rows(spark, hot):
    """A third of all rows have one id and text: shards are still near equal."""
    rng = random.Random(4)
    texts = [(hot, "the same words of one id")] * 2000 + [(i, "z" * rng.randint(10, 40) + str(i)) for i in range(100, 4100)]
    rows = shard_rows(table(spark, texts)).collect()
    assert sorted((r["doc_id"] or -1, r["text_crc32"]) for r in rows) == sorted((i or -1, zlib.crc32(t.encode())) for i, t in texts)
    per = [[r for r in rows if r["shard"] == s] for s in range(16)]
    assert all(sorted(r["slot"] for r in p) == list(range(len(p))) for p in per)
    held = [sum(r["size"] for r in p) for p in per]
    assert max(held) - min(held) < 0.05 * sum(held) / 16


def test_token_rollup(spark, tmp_path):
    docs = table(spark, [(1, "one two", "a"), (2, None, "a"), (3, "three", None), (4, "four five six", "b")])
    counts = token_counts(docs)
    assert {r["doc_id"]: r["words"] for r in counts.collect()} == {1: 2, 2: 0, 3: 1, 4: 3}
    rollup = TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    load = signed(counts, 1, "t@1", "words")
    assert rollup.commit("1", load) and not rollup.commit("1", load)
    assert rollup.commit("2", signed(counts.where("doc_id = 4"), -1, "t@1", "words"))
    assert rollup.commit("3", signed(counts.where("doc_id = 1"), -1, "t@1", "words").unionByName(signed(counts.where("doc_id = 1"), 1, "t@1", "subwords")))
    assert rollup.commit("4", load.where("false"))
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert got == {("a", "en"): (2, 2), (None, "en"): (1, 1)}


def test_compaction_changes_nothing(spark, tmp_path):
    """Totals are the same with and without compactions, broken ones and repeats; batches taken in can't be committed again."""
    rng = random.Random(8)
    plain, packed = TokenRollup(spark, str(tmp_path / "plain")), TokenRollup(spark, str(tmp_path / "packed"))
    want = {}
    for n in range(4):
        rows = [(rng.choice(["a", None]), rng.choice(["en", "de"]), rng.randint(0, 9)) for _ in range(20)] * 2
        changes = signed(spark.createDataFrame(rows, "source string, lang string, words long"), -1 if n == 2 else 1, "t@1", "words")
        assert plain.commit(f"b{n}", changes) and packed.commit(f"b{n}", changes)
        for s, l, w in rows:
            docs, tokens = want.get((s, l), (0, 0))
            want[s, l] = (docs + (-1 if n == 2 else 1), tokens + (-w if n == 2 else w))
        if n != 1:
            assert packed.compact() == (2 if n == 2 else 1) and packed.compact() == 0
        assert not packed.commit(f"b{n}", changes)
    changes.write.parquet(str(tmp_path / "packed" / "ids-000000000009"))  # a compaction that broke off before its sums
    for rollup in (plain, packed):
        got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
        assert got == {g: x for g, x in want.items() if x != (0, 0)}
    assert packed.committed() == [] and len(list((tmp_path / "packed").glob("batch-*"))) == 0


def test_token_query_is_brute_force(spark, tmp_path):
    """The registered query's five batches, on a table with nulls, repeated rows and a long text, counted by hand."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    texts = [(i % 40, ["one two", None, "", "Straße 42!", "x " * 30_000][i % 5], ["a", None][i % 2]) for i in range(60)] + [(None, "no id", "a")]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t, s in texts:
        words, subwords = len(words_of(t)), len(whole.encode(t or "", add_special_tokens=False).ids)
        for name, docs, tokens in [("words@1", 1, words), ("word_bpe_49k@1", 1, subwords)]:
            d, n = want.get((s, "en", name), (0, 0))
            want[s, "en", name] = (d + docs, n + tokens)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in op5_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_subwords_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + ["It's 42's <|endoftext|> Éa­b ﬁ 你好\x1c", "don't'll x y ퟿", "", "a" * 5000]
    docs = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["subwords"] for r in token_counts(docs).collect()}
    assert all(got[i] == len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma!", "42nd"]) for _ in range(rng.choice([0, 3, 50, 900, 6000])))) for i in range(120)] + [(500, None), (501, ""), (501, ""), (None, "x y")]
    rows = pack_documents(table(spark, texts), group_pieces=50, with_ids=True).collect()
    ids = {}
    for r in rows:
        piece = np.frombuffer(r["ids"], "<u4")
        assert len(piece) == r["length"] <= 4096 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        ids.setdefault(r["doc_id"], []).append((r["start"], piece.tolist(), r["doc_tokens"]))
    for i, t in texts:
        if i != 501:
            joined = [x for _, p, _ in sorted(ids[i]) for x in p]
            assert joined == [*whole.encode(t or "", add_special_tokens=False).ids, 2] and ids[i][0][2] == len(joined)
    assert len(ids[501]) == 2
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = np.sort(np.array([rng.randint(1, 100) for _ in range(500)]))[::-1]
    where, _ = first_fit_decreasing(lengths, 100)
    room = []
    for size, got in zip(lengths, where):
        fits = next((b for b, left in enumerate(room) if left >= size), len(room))
        room += [100] * (fits == len(room))
        room[fits] -= size
        assert got == fits


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).join(labels.where("toxic is not null"), "doc_id").where(held_out(F.col("doc_id"))).select("score", "toxic").toArrow()
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.9
    # labels of held-out documents change nothing
    other = fit_toxicity(docs, labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(model.scorer.weights, other.scorer.weights)
    odd = score_toxicity(table(spark, [(1, None), (1, None), (2, ""), (None, "you " * 60000)]), model).collect()
    assert len(odd) == 4 and len({r["score"] for r in odd if r["doc_id"] != None}) == 1 and all(0 <= r["score"] <= 1 for r in odd)  # noqa: E711


def test_quality_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    got = score_quality(docs, model).join(labels, "doc_id").select("score", "quality").toArrow()
    score, label = got["score"].to_numpy(), got["quality"].to_numpy()
    assert auc(score, label) > 0.8 and (score[label == 1] >= 0.5).mean() > 0.97
    odd = score_quality(table(spark, [(1, None), (2, ""), (3, "!!! ### $$$ " * 9000), (None, "word " * 3)]), model).collect()
    assert len(odd) == 4 and {r["doc_id"] for r in odd if not r["keep"]} >= {1, 2, 3}


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """A hundred rows of one id are one row of a sample."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = table(spark, [(i, f"you are text {i}") for i in ids] + [(ids[0], f"other text {j % 50}") for j in range(100)] + [(None, "no id")])
    labels = spark.createDataFrame([(i, i % 2, 1) for i in ids], "doc_id long, toxic int, quality int")
    first, again = (toxicity._sample(docs.repartition(n), labels) for n in (3, 5))
    assert len(first[3]) == len(ids) and first[3].sum() == sum(i % 2 for i in ids)
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    fitted = []
    monkeypatch.setattr(quality, "train_scorer", lambda indices, offsets, target, *rest, **named: fitted.append(len(target)))
    fit_quality(docs)
    fit_quality(docs, sample=10)
    assert fitted == [len(ids), 10]


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert jaccard_components(none).count() == mix_sources(none).count() == shard_rows(none).count() == pack_documents(none).count() == token_counts(none).count() == 0
    assert score_toxicity(none, fit_toxicity(none, labels)).count() == score_quality(none, fit_quality(none)).count() == 0
