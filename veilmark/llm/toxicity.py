"""Toxicity (numbered operator 1): weak supervision by many lexicon and pattern voters.

Twenty-two voters fire on a text's words and marks: lexicons of insults by theme and by language, eight lexicons of words and
of word beginnings mined from a bounded sample of labelled training documents, repeated and frequent hits, and patterns of
address and of loudness next to a hit.  A generative label model estimates from the vote patterns of all documents, and those
of the sample whose label is known, how accurate each voter is and which voters repeat each other.  A known label is one more
voter of fixed accuracy.  The posterior labels of that sample and of a second one drawn from all documents, most of which have
no label, train a linear classifier on hashed words and word beginnings, which scores every whole text.

Known labels enter only through documents whose crc32(doc_id) mod 5 isn't 0; language, source and id are no inputs.

Nulls: a null text is an empty one and gets the classifier's bias; rows with null labels or a null id aren't learned from.
Repeated rows get equal scores.  Without any labels the lexicons alone decide.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veilmark.llm.stages import one_row_each, small_batches
from veilmark.llm.textblocks import WordBlock, blocks
from veilmark.llm.weaklabel import LabelModel, LinearScorer, bucket_sums, parts, train_scorer

BUCKETS = 1 << 19
SAMPLE = (4000, 6000)  # labelled training documents that are toxic, and that aren't
UNLABELLED, UNLABELLED_SHARE = 3000, 0.3  # documents of the second sample; their weight against that of the first
TRUST = 0.97  # how often a known label is taken to be right
# Insults by theme and language, and words of direct address.
LEXICONS = {
    "stupidity": ["clown", "cretin", "dumb", "dumbass", "fool", "idiot", "idiotic", "idiots", "imbecile", "lunatic", "moron", "moronic", "morons", "psycho", "stupid"],
    "filth": ["arsehole", "asshole", "bastard", "bitch", "crap", "filth", "filthy", "garbage", "pig", "rat", "scum", "shit", "slut", "trash", "vermin"],
    "hate": ["damn", "disgusting", "hate", "horrible", "kill", "nasty", "repulsive", "shut", "sick", "terrible", "ugly", "vile"],
    "contempt": ["coward", "creep", "degenerate", "freak", "jerk", "lazy", "liar", "loser", "losers", "parasite", "pathetic", "sucker", "useless", "weak", "worthless"],
    "german": ["abschaum", "arschloch", "blöd", "depp", "dreck", "dumm", "dummkopf", "erbärmlich", "feigling", "hass", "idioten", "lügner", "mistkerl", "schwein", "trottel", "versager", "wertlos"],
    "french": ["abruti", "connard", "crétin", "débile", "imbécile", "lâche", "menteur", "minable", "nul", "ordure", "pathétique", "raclure", "salaud", "stupide", "vermine"],
    "spanish": ["asqueroso", "basura", "bobo", "cobarde", "escoria", "estúpido", "idiota", "imbécil", "inútil", "mentiroso", "odio", "patético", "perdedor", "tonto", "vago"],
}
ADDRESS = ["you", "your", "yourself", "du", "dich", "dein", "tu", "toi", "ton", "usted", "vous"]
GROUPS = 4  # mined words, and mined beginnings, are dealt to so many lexicons each
VOTERS = [*LEXICONS, *(f"mined_words_{i}" for i in range(GROUPS)), *(f"mined_beginnings_{i}" for i in range(GROUPS)), "two_hits", "three_hits", "share_of_hits", "dense_hits", "address_and_hit", "loud_and_hit", "capitals_and_hit"]
_ADDRESS_BIT = len(LEXICONS) + 2 * GROUPS
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def loudness(raws: list[bytes], words: np.ndarray) -> np.ndarray:
    """1 where a tenth of the words have an exclamation mark, 2 more where a third of the Latin letters are capitals."""
    capitals = [len(r) - len(r.translate(None, _CAPITALS)) for r in raws]
    letters = [len(r) - len(r.translate(None, _LETTERS)) for r in raws]
    loud = np.array([r.count(b"!") for r in raws]) * 10 >= np.maximum(words, 1)
    return loud.astype(np.int64) + 2 * (np.array(capitals) * 3 >= np.maximum(letters, 1))


def text_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets, words): the distinct hashed words and word beginnings of each text, and its number of words.

    Even buckets are whole words without the marks around them, odd ones beginnings of 4 to 7 bytes of longer words.
    """
    block = WordBlock(raws)
    start, end = block.start.copy(), block.end.copy()
    for _ in range(3):
        end = end - (_MARK[block.bytes[np.maximum(end - 1, 0)]] & (end > start + 1))
        start = start + (_MARK[block.bytes[start]] & (end > start + 1)) if len(start) else start
    half = np.uint64(BUCKETS // 2)
    words = (block.spans(start, end) % half).astype(np.int64) * 2
    begins = []
    for size in (4, 5, 6, 7):
        long = np.flatnonzero(end - start > size)
        begins.append((np.searchsorted(long, block.offsets), (block.spans(start[long], start[long] + size) % half).astype(np.int64) * 2 + 1))
    at, out, offsets = block.offsets, [], [0]
    for i in range(len(raws)):
        a, b = at[i], at[i + 1]
        got = np.unique(np.concatenate([words[a:b], *(x[p[i] : p[i + 1]] for p, x in begins)]))
        out.append(got)
        offsets.append(offsets[-1] + len(got))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(offsets), np.diff(at)


def word_buckets(words: list[str]) -> np.ndarray:
    return np.array(sorted({int(text_features([w.encode()])[0][0]) for w in words}), dtype=np.int64)


@dataclass
class Voters:
    """The lexicons as bits of each bucket: those of LEXICONS, of mined words, of mined beginnings, and of address."""

    kinds: np.ndarray

    @staticmethod
    def of(mined: np.ndarray) -> Voters:
        kinds = np.zeros(BUCKETS, dtype=np.int32)
        for bit, words in (*enumerate(LEXICONS.values()), (_ADDRESS_BIT, ADDRESS)):
            kinds[word_buckets(words)] |= 1 << bit
        for bucket in mined.tolist():
            kinds[bucket] |= 1 << (len(LEXICONS) + GROUPS * (bucket % 2) + bucket // 2 % GROUPS)
        return Voters(kinds)

    def patterns(self, indices: np.ndarray, offsets: np.ndarray, words: np.ndarray, loud: np.ndarray) -> np.ndarray:
        """The votes of each text as bits, in the order of VOTERS."""
        kinds = self.kinds[indices]
        count = lambda mask: _sums(((kinds & mask) != 0).astype(np.int64), offsets)
        hits = count((1 << _ADDRESS_BIT) - 1)
        some, many = hits > 0, np.maximum(words, 1)
        fired = [count(1 << bit) > 0 for bit in range(_ADDRESS_BIT)]
        fired += [hits >= 2, hits >= 3, hits * 100 >= many, some & (hits * 20 >= many), some & (count(1 << _ADDRESS_BIT) > 0), some & (loud % 2 > 0), some & (loud >= 2)]
        return sum(f.astype(np.int64) << j for j, f in enumerate(fired))


def _patterns(voters: Voters, indices: np.ndarray, offsets: np.ndarray, words: np.ndarray, loud: np.ndarray) -> np.ndarray:
    """The votes of a whole sample, part by part."""
    each = [voters.patterns(indices[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words[a:b], loud[a:b]) for a, b in parts(offsets)]
    return np.concatenate(each) if each else np.zeros(0, np.int64)


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[offsets[1:]] - total[offsets[:-1]]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, ...]:
    """Features of at most sum(SAMPLE) labelled training documents: buckets, offsets, words, label, share of its label's rows,
    loudness.

    Of rows that share an id, one is taken, as labels are of ids.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for toxic, most in zip((1, 0), SAMPLE):
        part = known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    # at most sum(SAMPLE) rows: one of each id
    rows = one_row_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "toxic").select(F.col("toxic").cast("int"), "text")
    indices, offsets, words, loud, toxic = _features(rows)
    counts = np.array([max(1, (toxic == c).sum()) for c in (0, 1)])
    share = np.array([totals.get(0, 0), totals.get(1, 0)]) / counts
    return indices, offsets, words, toxic, share[toxic.astype(int)], loud


def _unlabelled(docs: DataFrame) -> tuple[np.ndarray, ...]:
    """Features of UNLABELLED documents, whether they have a label or not: buckets, offsets, words, loudness."""
    order = F.xxhash64("doc_id", F.lit(19))
    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(UNLABELLED)
    rows = one_row_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id")  # UNLABELLED rows at most
    return _features(rows.select(F.lit(0).alias("toxic"), "text"))[:4]


def _features(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """Of a bounded number of `rows` (toxic, text), on the driver: buckets, offsets, words, loudness, toxic."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, texts = batch.column(0), batch.column(1)
            for first, last, raws in blocks(texts):
                got, offsets, words = text_features(raws)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([label.slice(first, last - first), pa.array(words, pa.int64()), pa.array(loudness(raws, words)), lists], ["toxic", "words", "loud", "buckets"])

    table = rows.mapInArrow(features, "toxic int, words bigint, loud bigint, buckets array<int>").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lists = table["buckets"].combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return lists.flatten().to_numpy(), offsets, table["words"].to_numpy(), table["loud"].to_numpy(), table["toxic"].to_numpy().astype(float)


def mine(indices: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, weight: np.ndarray, least: int = 5, odds: float = 12.0) -> np.ndarray:
    """Buckets met in `least` toxic documents or more that are `odds` times as frequent there, by a cautious estimate."""
    n = [max(1.0, weight[toxic == c].sum()) for c in (0, 1)]
    seen = bucket_sums(indices, offsets, BUCKETS, toxic)
    raw = [bucket_sums(indices, offsets, BUCKETS, weight * (toxic == c)) for c in (0, 1)]
    base = weight[toxic == 0].mean() if (toxic == 0).any() else 1.0
    ratio = (np.maximum(raw[1] - np.sqrt(raw[1]), 0) / n[1]) / ((raw[0] + base) / n[0])
    return np.flatnonzero((seen >= least) & (ratio >= odds))


@dataclass
class ToxicityModel:
    label_model: LabelModel
    scorer: LinearScorer
    mined: np.ndarray


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from all `docs` (doc_id, text) and the training rows of `labels` (doc_id, toxic)."""
    indices, offsets, words, toxic, weight, loud = _sample(small_batches(docs), labels)
    mined = mine(indices, offsets, toxic, weight)
    voters = Voters.of(mined)
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # 4 bytes a bucket

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, int] = {}
            for _, _, raws in blocks(batch.column(0)):
                indices, offsets, words = text_features(raws)
                for pattern, n in zip(*np.unique(shared.value.patterns(indices, offsets, words, loudness(raws, words)), return_counts=True)):
                    counts[int(pattern)] = counts.get(int(pattern), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    seen = docs.select("text").mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # a row for each pattern that occurs
    own = _patterns(voters, indices, offsets, words, loud)
    patterns = np.unique(np.concatenate([np.array([r["pattern"] for r in seen], dtype=np.int64), own]))
    counts = np.zeros(len(patterns))
    for r in seen:
        counts[np.searchsorted(patterns, r["pattern"])] = r["n"]
    at = np.searchsorted(patterns, own)
    gold = np.stack([np.bincount(at, weights=weight * (toxic == c), minlength=len(patterns)) for c in (0, 1)], axis=1)
    known = gold.sum()
    prior = float(np.clip(gold[:, 1].sum() / known, 0.001, 0.5)) if known else 0.05
    model = LabelModel(VOTERS).fit(patterns, counts, gold, first_hit=(0.005, 0.5), prior=prior, steadiness=0.02)
    odds = model.log_odds(own) + np.where(toxic == 1, 1, -1) * np.log(TRUST / (1 - TRUST)) if len(toxic) else np.zeros(0)
    more = _unlabelled(docs)
    target = 1 / (1 + np.exp(-np.clip(np.concatenate([odds, model.log_odds(_patterns(voters, *more))]), -30, 30)))
    extra = len(more[2])
    weights = np.concatenate([weight, np.full(extra, UNLABELLED_SHARE * max(1.0, weight.sum()) / max(1, extra))])
    indices, offsets = np.concatenate([indices, more[0]]), np.concatenate([offsets, offsets[-1] + more[1][1:]])
    del more
    scorer = train_scorer(indices, offsets, target, weights, BUCKETS, screen=0.03)
    if not len(toxic):
        scorer = LinearScorer(BUCKETS, np.where(voters.kinds & ((1 << len(LEXICONS)) - 1), 3.0, 0.0), -2.0)
    return ToxicityModel(model, scorer, mined)


def score_toxicity_rows(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs`, all their columns kept, with score; an own column of that name gives way."""
    scorer = docs.sparkSession.sparkContext.broadcast(model.scorer)  # 8 bytes a bucket
    rows = small_batches(docs).drop("score")
    place = rows.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, raws in blocks(batch.column(place)):
                found.append(scorer.value.scores(*text_features(raws)[:2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, "score"])

    return rows.mapInArrow(score, StructType([*rows.schema, StructField("score", DoubleType())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, score, predicted."""
    return score_toxicity_rows(docs.select("doc_id", "text"), model).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
