"""N-gram Jaccard join (numbered operator 2): T-occurrence search with DivideSkip.

A document's set holds the distinct k-word shingles of its whole text, as 64-bit hashes of keyed word digests.  Rows with
equal sets are one class, compared once.  Of n shingles a linked pair shares at least `percent` of the larger set, so among
each set's first n - ceil(percent n) + l hashes in hash order the pair shares at least l; these "leads" have the inverted
lists.  What is left is a T-occurrence problem with T = l, solved as DivideSkip does: a class's lists are put in order of
length and all but its T - 1 longest are merged, which counts the lists that each possible partner shares; a partner whose
count is short of T is probed by binary search in the other's sorted leads.  Partners that reach T are verified on the whole
sets.  Spark's shuffle by list does the merging.

Large groups: a first pass links each class with the smallest classes of its lists, and the classes so connected count as
one in the lists' lengths.  Lists within one component need no merging, so a group of thousands of near copies costs rows in
proportion to its size.

Long lists that must be merged all the same come from passages that very many documents share.  Their classes are ordered
anew on their whole sets, rarest shingles first: of n shingles a linked pair shares one of the first n - ceil(percent n) + 1
in any common order, so a document leaves a long list unless nearly all it has is shared by very many.  Which shingles are
frequent is held in bit tables of fixed size; they decide an order and never whether a pair counts.  Documents that have
nothing but frequent shingles are compared in blocks, all overlaps of a block at once, each returning a spanning forest.

Nulls: null and empty texts have empty sets and link with nothing; with fewer than k words the whole sequence is one
shingle.  Rows with a null id link with nothing and get a null component.  Rows that share an id are one document.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from veilmark.llm.components import components
from veilmark.llm.stages import cut, small_batches
from veilmark.llm.textblocks import blocks, shingle_sets
from veilmark.llm.vecdedup import forest

PIVOTS, FILTER_BITS, LONG_LIST, SALTS, LEVELS = 2, 1 << 23, 48, 64, 3
LIST_BLOCK, BLOCK_SHINGLES, DENSE_CELLS = 1024, 400_000, 4_000_000  # of a block of a long list: rows, shingles; cells counted at once


def lead_size(n: int, percent: int) -> tuple[int, int]:
    """(size of the lead, l) for a set of n."""
    free = n - -(-percent * n // 100) + 1
    depth = (free + 1) // 2
    return min(n, free + depth - 1), depth


def _needed(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100.0 - 1e-9)


def _depth(n: Column, percent: int) -> Column:
    return F.floor((n - _needed(n, percent) + 2) / 2).cast("long")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _numbers(lists: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in lists]


def _digest(numbers: np.ndarray) -> bytes | None:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest() if len(numbers) else None


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every row's columns but the text, which must be the last, and n, digest, lead."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raws in blocks(batch.columns[-1]):
                sets = shingle_sets(raws, k)
                leads = _lists([s[: lead_size(len(s), percent)[0]] for s in sets])
                kept = [c.slice(first, last - first) for c in batch.columns[:-1]]
                columns = [*kept, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), leads]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n", "digest", "lead"])

    added = [StructField("n", LongType()), StructField("digest", BinaryType()), StructField("lead", ArrayType(LongType()))]
    return docs.mapInArrow(make, StructType([*docs.schema.fields[:-1], *added]))


def _bits(values: DataFrame) -> np.ndarray:
    """A bit table of fixed size (FILTER_BITS / 8 bytes) over `values` (v, a 64-bit number)."""
    bits = values.select(F.pmod(F.xxhash64("v"), F.lit(FILTER_BITS)).alias("bit")).distinct()
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 32) as int))")).alias("mask")).collect()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for row in words:
        out[row["word"]] = row["mask"]
    return out


def _among(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1


@dataclass
class Linked:
    """`rows`: the given columns but the text, n, digest, salt.  `classes`: id, tag, n, lead.  `class_of`: digest, salt, id.
    `edges`: (a, b) between ids of classes, which connect all that link."""

    rows: DataFrame
    classes: DataFrame
    class_of: DataFrame
    edges: DataFrame


def link_classes(docs: DataFrame, k: int, percent: int) -> Linked:
    """Link the distinct sets of `docs`, whose columns are tag (bigint; null: takes no part), any others, and last text.

    Rows of one class are dealt by a written salt wherever they meet, so a class may hold any share of all rows.
    """
    sets = cut(_sets(small_batches(docs), k, percent).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    filled = sets.where("digest is not null and tag is not null")
    parts = cut(filled.groupBy("digest", "salt").agg(F.min("tag").alias("tag"), F.any_value(F.struct("n", "lead")).alias("s")))
    merged = parts.groupBy("digest").agg(F.min("tag").alias("tag"), F.any_value("s").alias("s"))  # SALTS rows a class at most
    classes = cut(merged.select(F.monotonically_increasing_id().alias("id"), "tag", "digest", "s.n", "s.lead"))
    class_of = parts.select("digest", "salt").join(classes.select("digest", "id"), "digest")
    postings = classes.select("id", "n", F.explode("lead").alias("h"))
    shared = postings.groupBy("h").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    lists = cut(postings.join(shared.select("h"), "h"))
    source = Texts(docs.where("tag is not null"), classes, k)
    near = _pivot_links(lists, source, percent)
    rest = _cross_links(lists, components(near), source, percent)
    return Linked(sets.drop("lead"), classes, class_of, near.unionByName(rest))


@dataclass
class Texts:
    """Where the whole sets of classes come from: they are made again from the texts, only for those asked for."""

    docs: DataFrame
    classes: DataFrame
    k: int

    def whole_sets(self, asked: DataFrame) -> DataFrame:
        """(id, whole), one row for each of the classes `asked` (id) for."""
        named = cut(self.classes.select("id", "tag", "digest").join(asked, "id", "left_semi"))
        held, k = self.docs.sparkSession.sparkContext.broadcast(_bits(named.select(F.col("tag").alias("v")))), self.k  # FILTER_BITS / 8 bytes

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[tuple[int, bytes]] = set()  # of this task: rows with one tag and set are sent once
            for batch in batches:
                batch = batch.take(pa.array(np.flatnonzero(_among(held.value, batch.column(1).to_numpy()))))
                tags = batch.column(0).to_pylist()
                for first, last, raws in blocks(batch.column(2)):
                    made = shingle_sets(raws, k)
                    digests = [_digest(s) for s in made]
                    new = []
                    for i, name in enumerate(zip(tags[first:last], digests)):
                        if name[1] is not None and name not in sent:
                            sent.add(name)
                            new.append(i)
                    columns = [pa.array([tags[first + i] for i in new], pa.int64()), pa.array([digests[i] for i in new], pa.binary()), _lists([made[i] for i in new])]
                    yield pa.RecordBatch.from_arrays(columns, ["tag", "digest", "whole"])

        rows = self.docs.select("tag", F.pmod(F.xxhash64("tag"), F.lit(FILTER_BITS)).alias("bit"), "text")
        found = rows.mapInArrow(sets, "tag bigint, digest binary, whole array<bigint>").join(named, ["tag", "digest"])
        return found.groupBy("id").agg(F.any_value("whole").alias("whole"))


def _two_sided(pairs: DataFrame, sides: DataFrame, column: str) -> DataFrame:
    """`pairs` (a, b, ...) with left and right, the `column` of each side's id."""
    left = sides.select(F.col("id").alias("a"), F.col(column).alias("left"))
    right = sides.select(F.col("id").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (a, b), those whose whole sets overlap enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(_numbers(batch.column("left")), _numbers(batch.column("right")))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _two_sided(pairs, whole, "whole").select("a", "b", "left", "right").mapInArrow(check, "a bigint, b bigint")


def _probed(pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """Of `pairs` (a, b, need), those with `need` common leads, by binary search of one side's leads in the other's."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, need = [], batch.column("need").to_numpy()
            for row, (x, y) in enumerate(zip(_numbers(batch.column("left")), _numbers(batch.column("right")))):
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                if np.count_nonzero(long[at] == short) >= need[row]:
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return _two_sided(pairs, leads, "lead").select("a", "b", "need", "left", "right").mapInArrow(probe, "a bigint, b bigint")


def _similar_sizes(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _pivot_links(lists: DataFrame, source: Texts, percent: int) -> DataFrame:
    """Verified links of each class with the smallest classes of its lists: linear in the lists."""
    pivot = lists.groupBy("h").agg(F.min(F.struct("id", "n")).alias("pivot"))
    met = lists.join(pivot, "h").where((F.col("id") != F.col("pivot.id")) & _similar_sizes(F.col("n"), F.col("pivot.n"), percent))
    counts = met.groupBy("id", F.col("pivot.id").alias("b"), F.least("n", F.col("pivot.n")).alias("m")).agg(F.count(F.lit(1)).alias("met"))
    enough = counts.where(F.col("met") * 2 >= _depth(F.col("m"), percent))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("met").desc(), "b"))
    pairs = cut(enough.withColumn("place", best).where(F.col("place") <= PIVOTS).select(F.col("b").alias("a"), F.col("id").alias("b")))
    return cut(_verified(pairs, source.whole_sets(_ids(pairs)), percent))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Of `rows` (h, id, n, component) of short lists: (a, b, m, merged), m being the smaller size, merged the lists they share."""
    other = rows.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("other"))
    met = rows.join(other, "h").where((F.col("id") < F.col("b")) & (F.col("component") != F.col("other")) & _similar_sizes(F.col("n"), F.col("nb"), percent))
    return met.groupBy(F.col("id").alias("a"), "b", F.least("n", "nb").alias("m")).agg(F.count(F.lit(1)).alias("merged"))


def _cross_links(lists: DataFrame, first: DataFrame, source: Texts, percent: int) -> DataFrame:
    """All verified links between different components of `first`."""
    placed = lists.join(first, lists["id"] == first["node"], "left").select("h", "id", "n", F.coalesce("component", "id").alias("component"))
    length = placed.select("h", "component").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    placed = placed.join(length, "h")
    place = F.row_number().over(Window.partitionBy("id").orderBy("length", "h"))
    held = F.count(F.lit(1)).over(Window.partitionBy("id"))
    # all but the T - 1 longest lists of a class are merged; T is that of its smallest possible partner
    least = _depth(_needed(F.col("n"), percent), percent)
    merged = placed.withColumns({"place": place, "held": held}).where(F.col("place") <= F.col("held") - least + 1)
    merged = cut(merged.select("h", "id", "n", "component"))
    size = merged.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    found = cut(_pairs(merged.join(size.where(F.col("size") <= LONG_LIST), "h").drop("size"), percent).withColumn("need", _depth(F.col("m"), percent)))
    short = found.where("merged < need")
    probed = cut(found.where("merged >= need").select("a", "b").unionByName(_probed(short.select("a", "b", "need"), source.classes.join(_ids(short), "id", "left_semi"))))
    # a pair without a short list in common has its first common list among the long ones, on both sides
    common = merged.join(size.where(F.col("size") > LONG_LIST), "h").select("id", "n", "component").distinct()
    common = cut(common)
    whole = cut(source.whole_sets(_ids(probed).unionByName(common.select("id")).distinct()))
    return cut(_verified(probed, whole, percent)).unionByName(_rare_first_links(common.join(whole, "id"), percent))


def _rare_first_links(rows: DataFrame, percent: int) -> DataFrame:
    """All verified links between different components among `rows` (id, n, component, whole), by their rarest shingles."""
    rows = cut(rows)
    spark = rows.sparkSession
    each = rows.select("component", F.explode("whole").alias("h")).groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = cut(each.groupBy("h").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("h").alias("v"), "size"))
    # the thresholds of what is frequent rise until the bit tables aren't crowded
    grades = {r["grade"]: r["count"] for r in lists.groupBy(F.floor(F.log2("size")).cast("int").alias("grade")).count().collect()}  # 63 rows at most
    least = LONG_LIST.bit_length() - 1
    while sum(n for g, n in grades.items() if g >= least) > FILTER_BITS // 16:
        least += 1
    cuts = [1, *(LONG_LIST if least == LONG_LIST.bit_length() - 1 and i == 0 else 1 << (least + 2 * i) for i in range(LEVELS))]
    held = [spark.sparkContext.broadcast(_bits(lists.where(F.col("size") > c).select("v"))) for c in cuts]  # FILTER_BITS / 8 bytes each

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, n, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                bit = np.asarray(bits.values)
                level = sum(_among(table.value, bit).astype(np.int64) for table in held)
                order = np.lexsort((np.arange(n), level))[: n - -(-percent * n // 100) + 1]
                order = order[level[order] > 0]
                out[0].append(np.full(len(order), len(out[2]), dtype=np.int64))
                out[1].append(order)
                out[2].append(i)
            at = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
            picks = np.concatenate(out[1]) if out[1] else at
            starts = np.asarray(batch.column(4).offsets)[:-1] if len(at) else np.zeros(1, np.int64)
            values = np.asarray(batch.column(4).values)[starts[at] + picks] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), *(batch.column(j).take(pa.array(at, pa.int64())) for j in (0, 1, 2))], ["h", "id", "n", "component"])

    bits = F.transform("whole", lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_BITS)))
    prefix = cut(rows.select("id", "n", "component", bits.alias("bits"), "whole").mapInArrow(first, "h bigint, id bigint, n bigint, component bigint"))
    size = prefix.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").drop("low", "high")
    short = prefix.join(size.where(F.col("size") <= LONG_LIST), "h").select("h", "id", "n", "component")
    pairs = cut(_pairs(short, percent).select("a", "b"))
    whole = rows.select("id", "whole")
    return cut(_verified(pairs, whole, percent)).unionByName(_block_links(prefix.join(size.where(F.col("size") > LONG_LIST), "h"), whole, percent))


def _block_links(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Of `rows` (h, id, n, component, size, shingles), the rows of long lists: edges that connect all that link across components."""
    many = F.ceil(F.greatest(F.col("size") / LIST_BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id", "h"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = dealt.select("h", "id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def link(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        ids, own = table["id"].to_numpy(), table["own"].to_numpy()
        _, component = np.unique(table["component"].to_numpy(), return_inverse=True)
        sets = _numbers(table["whole"])
        sizes = np.array([len(x) for x in sets])
        words, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        holder = np.repeat(np.arange(len(sets)), sizes)
        shared = seen[at] > 1
        column = (np.cumsum(seen > 1) - 1)[at[shared]]
        holder = holder[shared]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        overlap = np.zeros((len(left), len(right)), dtype=np.float32)
        step = max(64, DENSE_CELLS // max(1, len(sets)))
        for first in range(0, int((seen > 1).sum()), step):
            part = (column >= first) & (column < first + step)
            has = np.zeros((len(sets), step), dtype=np.float32)
            has[holder[part], column[part] - first] = 1
            overlap += has @ has.T if low == high else has[left] @ has[right].T
        total = sizes[left][:, None] + sizes[right][None, :]
        linked = (100 * overlap >= percent * (total - overlap)) & (component[left][:, None] != component[right][None, :])
        x, y = np.nonzero(linked)
        root = forest(len(ids), [(left[x], right[y])])
        hung = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[hung], pa.int64()), "b": pa.array(ids[root[hung]], pa.int64())})

    return cut(dealt.join(whole, "id").groupBy("h", "low", "high").applyInArrow(link, "a bigint, b bigint").distinct())


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, n_shingles, component_id, one row for each row."""
    named = F.col("doc_id").cast("bigint")
    found = link_classes(docs.select(named.alias("tag"), named.alias("doc_id"), "text"), k, percent)
    tags = found.classes.select("id", "tag")
    edges = found.edges.join(tags.withColumnsRenamed({"id": "a", "tag": "x"}), "a").join(tags.withColumnsRenamed({"id": "b", "tag": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = found.rows
    # ids whose rows differ in their sets tie their classes together
    several = rows.where("digest is not null and tag is not null").groupBy("tag").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("tag")
    loose = rows.where("digest is not null").join(several, "tag", "left_semi").select("digest", "salt", F.col("tag").alias("a")).distinct()
    same = loose.join(found.class_of, ["digest", "salt"]).select("a", "id").distinct().join(tags, "id").select("a", F.col("tag").alias("b"))
    member = components(edges.unionByName(same))
    place = found.class_of.join(tags, "id").join(member, F.col("tag") == F.col("node"), "left")
    place = place.select("digest", "salt", F.coalesce("component", "tag").alias("component"))
    out = rows.join(place, ["digest", "salt"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
