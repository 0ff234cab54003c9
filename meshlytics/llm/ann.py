"""Nearest neighbours by inner product with score-aware (anisotropic) product quantisation.

Codebooks of 16 centres per pair of components (four bits) are fitted on a bounded sample. Both the fit and the codes
weigh the part of the residual that is parallel to the vector more than the rest, since that is what moves the largest
inner products (Guo and others, 2020). Every vector is coded once: the index is a table with a row for each block of
vectors, which holds its ids, packed codes and vectors. Queries are blocks too, and a task gets one of each; it scans the
codes with each query's four-bit tables, two tables of a byte's codes at a time, and reranks the best by exact inner
products; the best of all blocks are the result. Equal vectors of a block are scanned once and keep their smallest ids.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part; ties go to the smaller id; rows that share an id count once, the first by value; with fewer than ``top``
candidates all are returned; an empty table gives no rows; other columns, whatever their names, are neither read nor
returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved, ship

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 10_000
#: Rows of a block of vectors, and of a block of queries, about; and the most components that a block holds.
BLOCK, QUERIES_IN_BLOCK, BLOCK_VALUES = 16_384, 4096, 4_000_000
#: Candidates of a block that are reranked exactly, per neighbour asked for.
RERANK = 16
CENTRES, WIDTH = 16, 2


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``x`` (array<double>) of the rows that take part, one per id."""
    x = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    rows = rows.where((F.size("x") > 0) & F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))
    finite = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("x", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def eta(x: np.ndarray, share: float = 0.2) -> float:
    """How much more the parallel residual counts, for a threshold at ``share`` of the vector's norm."""
    d = x.shape[1]
    return max(1.0, (d - 1) * share**2 / (1 - share**2))


def _distances(part: np.ndarray, whole_unit: np.ndarray, residual_along: np.ndarray, centres: np.ndarray, weight: float) -> np.ndarray:
    """The loss of each row for each centre, other parts of the row's code held: the squared residual, and again,
    ``weight`` less one times, the square of its sum along the row's direction."""
    r = part[:, None, :] - centres[None]
    along = residual_along[:, None] + (r * whole_unit[:, None, :]).sum(2)
    return (r * r).sum(2) + (weight - 1) * along * along


def encode(x: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x parts): nearest centres, then coordinate descent on the anisotropic loss."""
    parts = books.shape[0]
    split = x.reshape(len(x), parts, WIDTH)
    unit = split / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    codes = np.stack([((split[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    residual = split - books[np.arange(parts)[None], codes]
    along = (residual * unit).sum(2)
    total = along.sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            other = total - along[:, p]
            codes[:, p] = _distances(split[:, p], unit[:, p], other, books[p], weight).argmin(1)
            along[:, p] = ((split[:, p] - books[p][codes[:, p]]) * unit[:, p]).sum(1)
            total = other + along[:, p]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, weight: float, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks (parts x 16 x 2): k-means, then rounds of anisotropic codes and the centres that are best for them."""
    n, d = x.shape
    parts = d // WIDTH
    split = x.reshape(n, parts, WIDTH)
    order = np.random.default_rng(seed)
    books = np.stack([split[order.integers(0, n, CENTRES), p] for p in range(parts)])
    for _ in range(8):
        for p in range(parts):
            k = ((split[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1)
            sums, counts = np.zeros((CENTRES, WIDTH)), np.bincount(k, minlength=CENTRES)
            np.add.at(sums, k, split[:, p])
            books[p] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], books[p])
    unit = split / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    for _ in range(rounds):
        codes = encode(x, books, weight, 1)
        residual = split - books[np.arange(parts)[None], codes]
        along = (residual * unit).sum(2)
        total = along.sum(1)
        for p in range(parts):
            other = total - along[:, p]
            # The best centre of a cell solves (n I + (w - 1) sum u u') c = sum x + (w - 1) sum (other + u.x) u.
            u, y = unit[:, p], split[:, p]
            t = other + (u * y).sum(1)
            for c in range(CENTRES):
                own = codes[:, p] == c
                if own.any():
                    a = own.sum() * np.eye(WIDTH) + (weight - 1) * u[own].T @ u[own]
                    books[p, c] = np.linalg.solve(a, y[own].sum(0) + (weight - 1) * (t[own][:, None] * u[own]).sum(0))
            along[:, p] = ((y - books[p][codes[:, p]]) * u).sum(1)
            total = other + along[:, p]
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes (rows x parts) of four bits as bytes (parts / 2 x rows), two to a byte; an odd last part goes with a zero."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return np.ascontiguousarray((codes[:, 0::2] * CENTRES + codes[:, 1::2]).T)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray):
    """For each query the sums of table entries of all rows, whose ``codes`` are packed. The two tables of a byte's codes are
    added up for each pair of entries first, so that a byte is one look-up."""
    parts = books.shape[0]
    tables = np.einsum("qpw,pcw->qpc", queries.reshape(len(queries), parts, WIDTH), books).astype(np.float32)
    if parts % 2:
        tables = np.concatenate([tables, np.zeros((len(queries), 1, CENTRES), np.float32)], 1)
    both = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    at = codes.astype(np.intp)
    for q in range(len(queries)):
        s = both[q, 0][at[0]]
        for p in range(1, len(at)):
            s += both[q, p][at[p]]
        yield s


def rerank_rows(rough: np.ndarray, x: np.ndarray, query: np.ndarray, top: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows to rank and their exact scores: the ``most`` best of the scan, and then each row that could still be among
    the ``top``, its error taken as up to three deviations of the errors seen. Near-equal vectors make these many."""
    near = np.arange(len(rough)) if len(rough) <= most else np.argpartition(-rough, most - 1)[:most]
    score = (x[near] * query).sum(1)
    if len(rough) > most and most > top:
        error = score - rough[near]
        reach = np.partition(score, -top)[-top] - error.mean() - 3 * error.std()
        more = np.setdiff1d(np.flatnonzero(rough >= reach), near, assume_unique=True)
        near, score = np.concatenate([near, more]), np.concatenate([score, (x[more] * query).sum(1)])
    return near, score


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20, rerank: int = RERANK,
    sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: of each query its ``top`` nearest of ``vectors``, its own id left out."""
    spark = vectors.sparkSession
    ship(spark)
    rows = saved(usable(vectors, key, vector), "vectors")
    asked = usable(queries, key, vector)
    n = rows.count()
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length["d"] if length else WIDTH
    wide = d + d % WIDTH
    rows, asked = rows.where(F.size("x") == d), saved(asked.where(F.size("x") == d), "queries")
    least = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = np.array(
        [r["x"] for r in rows.where(F.xxhash64("id") <= F.lit(least)).select("x").collect()]
    ) if least is not None else np.ones((1, d))
    some = np.pad(some, ((0, 0), (0, wide - d)))
    weight = eta(some)
    books = fit(some, weight)
    shared = spark.sparkContext.broadcast(books)  # 16 centres for each pair of components
    per_block = max(1, min(block, BLOCK_VALUES // wide))
    blocks, query_blocks = max(1, -(-n // per_block)), max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    lists = lambda x: x.astype("<i8").tobytes()

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        # Equal vectors tie at each query: only the smallest ids among them can be neighbours, one more for the query itself.
        first, group = np.unique(np.stack(pdf["x"].to_numpy()), axis=0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        codes = packed(encode(np.pad(first, ((0, 0), (0, wide - d))), shared.value, weight))
        return pd.DataFrame(
            {
                "b": pdf["b"].iloc[:1], "ids": [lists(ids[order])], "starts": [lists(starts)], "codes": [codes.tobytes()],
                "vectors": [first.astype("<f8").tobytes()]
            }
        )

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "q": pdf["q"].iloc[:1], "ids": [lists(pdf["id"].to_numpy())],
                "vectors": [np.stack(pdf["x"].to_numpy()).astype("<f8").tobytes()]
            }
        )

    indexed = saved(
        rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b").applyInPandas(
            index, "b long, ids binary, starts binary, codes binary, vectors binary"
        ),
        "index"
    )
    batches = saved(
        asked.withColumn(
            "q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks))
        ).groupBy("q").applyInPandas(gather, "q long, ids binary, vectors binary"),
        "batches"
    )
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))

    def task(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            row, ask = own.iloc[0], asked.iloc[0]
            ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
            ends = np.append(starts[1:], len(ids))
            first = np.frombuffer(row["vectors"], "<f8").reshape(-1, d)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(first))
            qid, qx = np.frombuffer(ask["ids"], "<i8"), np.frombuffer(ask["vectors"], "<f8").reshape(-1, d)
            for low in range(0, len(qid), 256):
                part = qx[low : low + 256]
                for i, rough in enumerate(scan(np.pad(part, ((0, 0), (0, wide - d))), codes, shared.value)):
                    near, score = rerank_rows(rough, first, part[i], top, top * rerank)
                    got, last = [], None
                    for r in np.lexsort((ids[starts[near]], -score)):
                        if len(got) >= top and score[r] != last:
                            break
                        last = score[r]
                        members = ids[starts[near[r]] : min(ends[near[r]], starts[near[r]] + top + 1)]
                        got += [(v, score[r]) for v in members if v != qid[low + i]]
                    got.sort(key=lambda g: (-g[1], g[0]))
                    found += [(qid[low + i], v, s) for v, s in got[:top]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    cells = indexed.withColumn("q", every(query_blocks)).groupBy("b", "q").cogroup(batches.withColumn("b", every(blocks)).groupBy("b", "q"))
    best = cells.applyInPandas(task, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, queries those whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op2_anisotropic_search": op2_anisotropic_search}
ORACLES: dict[str, str] = {}
