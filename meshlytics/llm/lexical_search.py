"""Ranked lexical search over K2-treaps of the grid of terms and documents.

One pass over the texts gives each document's number of terms and how often it holds each term of the items; document
frequencies and totals are aggregated from that over all documents. Rows of the grid are terms, the weightiest first,
columns are documents; a point is a term's impact (its part of a score) in a document. A shard of ``SHARD`` documents is
a quadtree over its part of the grid: a level is the mask of children of each cell that holds points, and the greatest
impact in it; a cell's first child stands behind the children of all cells before it, so no places are stored.

An item descends the rows of its terms together, best first over ranges of documents: a range's bound is the sum of the
greatest impacts of the cells where its terms' rows meet it, and is the exact score where the range is one document. In
each round the ``BEAM`` best ranges of every item are halved; ranges below the item's last place so far, or equal to it but with later
documents only, are dropped. So results are exact. The best of all shards are ranked at the end.

Terms and postings of items go to the tasks in blocks of about ``TERMS`` pairs of item and term, which bounds what the
driver and a task hold of them; each block is one more pass over the texts. Items of a task are worked through in groups
whose ranges fit ``SLOTS``.

Defined results: terms are runs of ASCII letters, digits and other characters than ASCII, A-Z in lower case; null and
empty texts have none and are never found; texts of any length are ordinary; rows that share a document id are documents
of their own; equal scores go by ascending id, null ids first; items that share an id (or have none) are one item with
the terms of all; an item without terms, or without a document that scores, has no rows; an empty table gives no rows;
other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, byte_slices, gathered, map_batches, read_table, release, saved, ship

#: Documents of a shard, and the most points of its grid, about.
SHARD, POINTS = 8192, 4_000_000
#: Ranges of an item that are halved in a round.
BEAM = 64
#: Pairs of item and term of a block, about.
TERMS = 100_000
#: Cells of rows and ranges that the items of a group hold at most.
SLOTS = 16_000_000
#: Bytes of texts that are cut into terms at once.
SLICE_BYTES = 4_000_000
TOP = 10


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` and ``term``, each pair once."""
    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("term", T.StringType())])

    def make(batch):
        words, before, _ = ascii_words(batch.column(1))
        return [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(before)))), words]

    return map_batches(items.select(F.col(key).alias("item"), F.col(text).alias("text")), make, schema).distinct()


def postings(docs: DataFrame, key: str, text: str, terms: pa.Array) -> DataFrame:
    """A row per document: ``key``, ``n`` (terms with repeats), ``terms`` (places in the given ones) and ``times``."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))
        ]
    )
    ship(docs.sparkSession)

    def make(batches):
        for batch in batches:
            for low, high in byte_slices(batch.column(1), SLICE_BYTES):
                words, before, _ = ascii_words(batch.column(1).slice(low, high - low))
                known = words.dictionary_encode()
                place = np.asarray(pc.fill_null(pc.index_in(known.dictionary, terms), -1), np.int64)
                at = place[np.asarray(known.indices, np.int64)]
                doc = np.repeat(np.arange(high - low), np.diff(before))
                own = at >= 0
                pairs, times = np.unique(doc[own] * max(len(terms), 1) + at[own], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(high - low + 1) * max(len(terms), 1)), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
                        (pairs % max(len(terms), 1)).astype(np.int32), times.astype(np.int64)
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(before), pa.int64()), *lists], schema.fieldNames()
                )
        release()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(make, schema)


class Treap:
    """The quadtree of points (row, column, impact), of which no two share a place. ``mask`` has a bit for each child of a
    cell (row half, then column half), ``first`` the place of its first child, ``most`` its greatest impact; cells of all
    levels stand one after the other, the root first, single places last."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.levels = max(int(max(rows.max(), columns.max())).bit_length(), 1)
        code = np.zeros(len(rows), np.int64)
        for b in range(self.levels):
            code |= ((rows >> b & 1) << 1 | columns >> b & 1) << 2 * b
        order = np.argsort(code)
        code, most = code[order], impacts[order]
        masks, maxima = [np.zeros(len(code), np.uint8)], [most]
        for _ in range(self.levels):
            above = code >> 2
            starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            masks.append(np.bitwise_or.reduceat(np.left_shift(1, code & 3).astype(np.uint8), starts))
            most = np.maximum.reduceat(most, starts)
            maxima.append(most)
            code = above[starts]
        self.mask, self.most = np.concatenate(masks[::-1]), np.concatenate(maxima[::-1])
        children = np.bitwise_count(self.mask).astype(np.int64)
        self.first = 1 + np.cumsum(children) - children

    def children(self, cells: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The child of each cell in a quadrant, -1 where it holds no points."""
        mask = self.mask[cells]
        place = self.first[cells] + np.bitwise_count(mask & (np.left_shift(1, quadrant) - 1).astype(np.uint8))
        return np.where(mask >> quadrant & 1 > 0, place, -1)


class Best:
    """The ``top`` documents of each item so far: score and column, the best first."""

    def __init__(self, items: int, top: int):
        self.score, self.column = np.zeros((items, top), np.int64), np.full((items, top), -1, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, column: np.ndarray) -> None:
        top = self.score.shape[1]
        touched = np.unique(item)
        held = self.column[touched] >= 0
        items = np.concatenate([np.repeat(touched, held.sum(1)), item])
        scores, columns = np.concatenate([self.score[touched][held], score]), np.concatenate([self.column[touched][held], column])
        order = np.lexsort((columns, -scores, items))
        items, scores, columns = items[order], scores[order], columns[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        ok = place < top
        self.score[items[ok], place[ok]], self.column[items[ok], place[ok]] = scores[ok], columns[ok]

    def open(self, item: np.ndarray, bound: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Which ranges, by their bounds and first columns, may still hold one of the best."""
        last, at = self.score[item, -1], self.column[item, -1]
        return (bound > last) | (bound == last) & (column < at) & (bound > 0)


def best_documents(tree: Treap, rows: np.ndarray, sizes: np.ndarray, top: int, beam: int = BEAM) -> Best:
    """The best columns of each item. ``rows``: of the terms of one item after the other, ``sizes`` of each."""
    items = len(sizes)
    best = Best(items, top)
    owner = np.repeat(np.arange(items), sizes)
    inside = rows < 1 << tree.levels
    rows, owner = rows[inside], owner[inside]
    live = np.unique(owner)
    # Ranges: item, level, number on the level, bound, and where the cells of its rows stand in ``cell`` and ``row``.
    item, level, number = live, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    start = np.searchsorted(owner, live)
    size = np.searchsorted(owner, live, "right") - start
    bound = size * int(tree.most[0])
    cell, row = np.zeros(len(rows), np.int64), rows
    while True:
        ok = best.open(item, bound, number << (tree.levels - level))
        item, level, number, bound, start, size = (x[ok] for x in (item, level, number, bound, start, size))
        if not len(item):
            return best
        order = np.lexsort((number << (tree.levels - level), -bound, item))
        item, level, number, bound, start, size = (x[order] for x in (item, level, number, bound, start, size))
        chosen = np.arange(len(item)) - np.searchsorted(item, item) < beam
        waits = ~chosen
        at = gathered(np.arange(len(cell)), start[chosen], size[chosen])
        of = np.repeat(np.arange(int(chosen.sum())), size[chosen])
        shift = tree.levels - 1 - level[chosen]
        half = (row[at] >> shift[of] & 1) << 1
        made = []
        for side in (0, 1):
            child = tree.children(cell[at], half | side)
            there = child >= 0
            own = of[there]
            sums = np.zeros(len(shift), np.int64)
            np.add.at(sums, own, tree.most[child[there]])
            made.append((sums, child[there], row[at][there], np.bincount(own, minlength=len(shift))))
        parts = [[item[chosen], level[chosen] + 1, number[chosen] * 2 + side, *made[side]] for side in (0, 1)]
        leaf = level[chosen] + 1 == tree.levels
        kept_at = gathered(np.arange(len(cell)), start[waits], size[waits])
        cells, rows_, ranges = [cell[kept_at]], [row[kept_at]], [(item[waits], level[waits], number[waits], bound[waits], size[waits])]
        for it, lv, no, sums, child, own_rows, counts in parts:
            found = leaf & (sums > 0)
            best.add(it[found], sums[found], no[found])
            stays = np.repeat(~leaf, counts)
            cells.append(child[stays])
            rows_.append(own_rows[stays])
            on = ~leaf
            ranges.append((it[on], lv[on], no[on], sums[on], counts[on]))
        item, level, number, bound, size = (np.concatenate(x) for x in zip(*ranges))
        cell, row = np.concatenate(cells), np.concatenate(rows_)
        start = np.cumsum(size) - size


def search_shards(
    rows: DataFrame, item_rows: np.ndarray, sizes: np.ndarray, place: np.ndarray, weights: np.ndarray, documents: int, length: int,
    top: int, size: int = SHARD, beam: int = BEAM, slots: int = SLOTS
) -> DataFrame:
    """``number`` of an item, ``key`` and ``score``: the best of each shard of the rows of ``postings``. ``place``: a term's row in the grid,
    ``weights`` by row."""
    schema = T.StructType([T.StructField("number", T.IntegerType()), rows.schema["key"], T.StructField("score", T.LongType())])
    ship(rows.sparkSession)

    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")], null_placement="at_start")).combine_chunks()
        lists, times = table.column("terms").chunk(0), table.column("times").chunk(0).flatten().to_numpy()
        column = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        row = place[lists.flatten().to_numpy()]
        m = 10 + 90 * table.column("n").to_numpy() * documents // length
        impact = weights[row] * (1_000_000_000 * times // (1000 * times + 8 * m[column]))
        some = impact > 0
        out = [[], [], []]
        if some.any():
            tree = Treap(row[some], column[some], impact[some])
            low, room = 0, slots // max(1, 2 * len(lists))
            ends = np.cumsum(sizes)
            while low < len(sizes):
                before = ends[low] - sizes[low]
                high = max(low + 1, int(np.searchsorted(ends, before + room, "right")))
                best = best_documents(tree, item_rows[before : ends[high - 1]], sizes[low:high], top, beam)
                found = best.column >= 0
                out[0].append(np.nonzero(found)[0] + low)
                out[1].append(best.column[found])
                out[2].append(best.score[found])
                low = high
        number, at, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), table.column("key").chunk(0).take(pa.array(at, pa.int64())), pa.array(score, pa.int64())],
            schema.fieldNames()
        )

    def run(batches):
        parts, docs, points = [], 0, 0
        for batch in batches:
            for low in range(0, batch.num_rows, size // 8):
                part = batch.slice(low, size // 8)
                parts.append(part)
                docs, points = docs + part.num_rows, points + len(part.column(2).flatten())
                if docs >= size or points >= POINTS:
                    yield shard(parts)
                    parts, docs, points = [], 0, 0
        if parts:
            yield shard(parts)
        release()

    return rows.mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    top: int = TOP, block: int = TERMS, shard: int = SHARD, beam: int = BEAM, slots: int = SLOTS
) -> DataFrame:
    """``item``, ``rank``, ``key`` and ``score`` of each item's best documents."""
    spark = docs.sparkSession
    pairs = saved(item_terms(items, item_key, item_text), "terms")
    number = max(1, -(-pairs.count() // block))
    own = F.pmod(F.xxhash64("item"), F.lit(number))
    out = None
    for k in range(number):
        part = pairs.where(own == k).toArrow()
        items_, terms = part.column("item").combine_chunks().dictionary_encode("encode"), part.column("term").combine_chunks().dictionary_encode()
        rows = saved(postings(docs, key, text, terms.dictionary), "postings")
        documents, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = dict(  # a block's terms at most
            tuple(r) for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
        )
        by_term = np.array([weight(documents, frequency.get(t, 0)) for t in range(len(terms.dictionary))], np.int64)
        order = np.argsort(-by_term, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        holder, at = np.asarray(items_.indices, np.int64), place[np.asarray(terms.indices, np.int64)]
        by = np.lexsort((at, holder))
        found = search_shards(
            rows, at[by], np.bincount(holder, minlength=len(items_.dictionary)), place, by_term[order], documents, max(length, 1), top,
            shard, beam, slots
        )
        label = spark.createDataFrame(
            pa.table({"number": pa.array(np.arange(len(items_.dictionary)), pa.int32()), "item": items_.dictionary})
        )
        found = found.join(F.broadcast(label), "number").drop("number")  # a block's items at most
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item", "rank", "key", "score")


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``benchmark`` in all documents: item_id, rank, doc_id, score."""
    found = search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


QUERIES = {"op13_treap_search": op13_treap_search}

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
words AS (SELECT d, doc_id, translate(unnest(regexp_extract_all(text, '{TERM}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM docs),
tf AS (SELECT d, doc_id, t, count(*) AS tf FROM words GROUP BY d, doc_id, t),
size AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
totals AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L FROM size),
weights AS (SELECT t, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
lengths AS (SELECT d, 100 - 90 + ((90 * n * N_) // L) AS m FROM size, totals),
terms AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '{TERM}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
scores AS (SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM terms JOIN tf USING (t) JOIN weights USING (t) JOIN lengths USING (d) GROUP BY item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
ORACLES = {"op13_treap_search": ORACLE}
