"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt by hash to shards of bounded size, equal vectors as one. A task builds each shard's graph, a
row of the index; then every vector queries every shard of its label: a beam search down the levels, then on along edges
between vectors that are near enough. Queries are dealt to smaller parts, each a row too, and a cell is a shard and a part,
so that there are many tasks and only packed rows are shuffled. In each cell some queries are audited against all vectors of the shard, and
the beam is doubled until no link is missed among them, at last to the whole shard. Cosines are verified in double
precision. A cell returns a count for each query and a forest of its links, so that groups of any size stay linear. When
the beam is set, as many other queries (if the cell has them) are compared with all vectors of the shard: what the search missed of their links is
returned, so that one minus missed over links is the recall, measured on queries that the beam was not set by.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths don't either; a null id is a component of its own (null) that is kept;
rows that share an id count as one vector, the first by label and value, and are each returned; a pair at exactly the
threshold is a link; an empty table gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, read_table, saved, ship

#: Vectors of a shard, about, and queries of a cell.
SHARD, PART = 8192, 2048
#: Neighbours on the upper levels and on the lowest, the beam while building and at first while searching.
M, M0, BUILD_BEAM, BEAM = 12, 24, 40, 24
#: Queries of a cell that its beam is set by, and others that its recall is measured on.
AUDIT = 128
#: What is returned of the audits.
AUDITED = ["beam", "audit_links", "audit_missed"]


class Graph:
    """A navigable small-world graph of unit vectors."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        self.x, n = x, len(x)
        self.levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 6)
        self.edges = [[None] * n for _ in range(7)]  # by level and node
        self.seen, self.stamp, self.entry, self.top = np.zeros(n, np.int64), 0, 0, int(self.levels[0]) if n else 0

    def build(self) -> "Graph":
        for v in range(len(self.x)):
            self._insert(v)
        return self

    def dump(self) -> bytes:
        out = {"x": self.x, "levels": self.levels, "entry": np.array([self.entry, self.top])}
        for k in range(self.top + 1):
            at = [v for v in range(len(self.x)) if self.edges[k][v] is not None]
            flat = [self.edges[k][v] for v in at]
            out |= {
                f"v{k}": np.array(at, np.int32), f"n{k}": np.array([len(e) for e in flat], np.int32),
                f"e{k}": np.array([y for e in flat for y in e], np.int32)
            }
        np.savez(f := io.BytesIO(), **out)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Graph":
        z = np.load(io.BytesIO(data))
        g = cls(z["x"])
        g.levels = z["levels"]
        g.entry, g.top = map(int, z["entry"])
        for k in range(g.top + 1):
            for v, e in zip(z[f"v{k}"].tolist(), np.split(z[f"e{k}"], np.cumsum(z[f"n{k}"])[:-1])):
                g.edges[k][v] = e
        return g

    def search(self, q: np.ndarray, entries: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest found, nearest last."""
        self.stamp += 1
        seen, stamp, edges, x = self.seen, self.stamp, self.edges[level], self.x
        for _, v in entries:
            seen[v] = stamp
        todo = [(-s, v) for s, v in entries]
        heapq.heapify(todo)
        best = list(entries)
        heapq.heapify(best)
        while todo:
            s, v = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = np.asarray(edges[v], np.int64)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for s, y in zip((x[near] @ q).tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (s, y))
                    heapq.heappush(todo, (-s, y))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, y))
                    heapq.heappush(todo, (-s, y))
        return sorted(best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for level in range(self.top, to, -1):
            at = self.search(q, at, 1, level)[-1:]
        return at

    def _spread(self, found: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """Neighbours that are nearer to the node than to each other; ``found`` is nearest first."""
        between, kept = self.x[found] @ self.x[found].T, []
        for i in range(len(found)):
            if len(kept) >= most:
                break
            if not kept or sims[i] > between[i, kept].max():
                kept.append(i)
        for i in range(len(found)):  # fill up with the nearest of the rest
            if len(kept) >= min(most, len(found)):
                break
            if i not in kept:
                kept.append(i)
        return found[kept].tolist()

    def _insert(self, v: int) -> None:
        level, q = int(self.levels[v]), self.x[v]
        for k in range(level + 1):
            self.edges[k][v] = []
        if v == 0:
            return
        at = self.descend(q, level) if level < self.top else [(float(self.x[self.entry] @ q), self.entry)]
        for k in range(min(level, self.top), -1, -1):
            at = self.search(q, at, BUILD_BEAM, k)
            found = np.array([y for _, y in reversed(at)])
            sims = np.array([s for s, _ in reversed(at)])
            most = M if k else M0
            for y in self._spread(found, sims, M):
                self.edges[k][v].append(y)
                back = self.edges[k][y]
                back.append(v)
                if len(back) > 2 * most:
                    b = np.array(back)
                    s = self.x[b] @ self.x[y]
                    o = np.argsort(-s, kind="stable")
                    self.edges[k][y] = self._spread(b[o], s[o], most)
        if level > self.top:
            self.entry, self.top = v, level

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """The nodes found whose inner product with ``q`` is ``least`` or more."""
        found = np.array([y for _, y in self.search(q, self.descend(q, 0), beam, 0)])
        self.stamp += 1
        self.seen[found] = self.stamp
        front = found[self.x[found] @ q >= least]
        out = [front]
        while len(front):
            near = np.unique(np.concatenate([np.asarray(self.edges[0][v], np.int64) for v in front]))
            near = near[self.seen[near] != self.stamp]
            self.seen[near] = self.stamp
            front = near[self.x[near] @ q >= least]
            out.append(front)
        return np.concatenate(out)


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``x`` of the vectors that can link, one per id."""
    x = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), x.alias("x")
    )
    rows = rows.where((F.size("x") > 0) & F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))
    rows = rows.where(F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy())
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, shard: int = SHARD,
    beam: int = BEAM, part: int = PART
) -> DataFrame:
    """A row per row of ``vectors``: ``key``, ``n_links``, ``component_id`` and ``kept``; then ``beam`` (the widest it was searched
    with), ``audit_links`` and ``audit_missed`` (links to different vectors that comparing it with all finds, and those of them the
    search missed; 0 where it was not audited; equal vectors share theirs), all 0 for rows that take no part."""
    ship(vectors.sparkSession)
    live = saved(usable(vectors, key, vector, label), "vectors")
    groups = saved(live.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "groups")
    sizes = groups.groupBy("label", F.size("x").alias("d")).agg(
        F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.count("*") / part).alias("parts")
    )
    dealt = groups.withColumn("d", F.size("x")).join(sizes, ["label", "d"]).withColumns(
        {"shard": F.pmod(F.xxhash64("rep"), F.col("shards")), "part": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))}
    )
    dealt = saved(dealt, "dealt")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        graph = Graph(unit(pdf["x"])).build()
        return pdf[["label", "d", "shard", "parts"]].iloc[:1].assign(
            graph=[graph.dump()], ids=[pdf["rep"].to_numpy().astype("<i8").tobytes()], ws=[pdf["w"].to_numpy().astype("<i8").tobytes()]
        )

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pdf[["label", "d", "part", "shards"]].iloc[:1].assign(
            reps=[pdf["rep"].to_numpy().astype("<i8").tobytes()], xs=[unit(pdf["x"]).astype("<f8").tobytes()]
        )

    kind = dealt.schema["label"].dataType.simpleString()
    index = saved(
        dealt.groupBy("label", "d", "shard").applyInPandas(
            build, f"label {kind}, d int, shard long, parts long, graph binary, ids binary, ws binary"
        ),
        "index"
    )
    parts = saved(
        dealt.groupBy("label", "d", "part").applyInPandas(gather, f"label {kind}, d int, part long, shards long, reps binary, xs binary"),
        "parts"
    )
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cells, asked = index.withColumn("part", every("parts")), parts.withColumn("shard", every("shards"))

    def query(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({c: [] for c in ("id", "n", "root", "beam", "links", "missed")}).astype("int64")
        graph, ids, ws = Graph.load(own["graph"].iloc[0]), np.frombuffer(own["ids"].iloc[0], "<i8"), np.frombuffer(own["ws"].iloc[0], "<i8")
        qid = np.frombuffer(asked["reps"].iloc[0], "<i8")
        q = np.frombuffer(asked["xs"].iloc[0], "<f8").reshape(len(qid), -1)
        width = beam
        order = np.random.default_rng(len(qid)).permutation(len(qid))
        audit, measured = order[:AUDIT], set(order[AUDIT : 2 * AUDIT].tolist())
        truth = graph.x @ q[audit].T >= least
        while width < len(ids):
            if all(np.array_equal(np.sort(graph.within(q[a], least, width)), np.flatnonzero(truth[:, k])) for k, a in enumerate(audit)):
                break
            width *= 2
        root = {}

        def find(v):
            while (up := root.setdefault(v, v)) != v:
                root[v] = root[up]
                v = up
            return v

        counts, links, missed = np.zeros((3, len(qid)), np.int64)
        for k in range(len(qid)):
            found = graph.within(q[k], least, width) if width < len(ids) else np.flatnonzero(graph.x @ q[k] >= least)
            found = found[ids[found] != qid[k]]
            counts[k] = ws[found].sum()
            if k in measured:
                real = np.flatnonzero((graph.x @ q[k] >= least) & (ids != qid[k]))
                links[k], missed[k] = len(real), len(np.setdiff1d(real, found))
            mine = find(int(qid[k]))
            for y in ids[found].tolist():
                other = find(y)
                if other != mine:
                    mine, other = min(mine, other), max(mine, other)
                    root[other] = mine
        nodes = np.array(sorted(root), np.int64)  # all queries are among them
        out = pd.DataFrame({"id": nodes, "root": [find(v) for v in nodes.tolist()]})
        of = pd.DataFrame({"id": qid, "n": counts, "beam": min(width, len(ids)), "links": links, "missed": missed})
        return out.merge(of, "left", "id").fillna(0).astype("int64")[["id", "n", "root", "beam", "links", "missed"]]

    found = cells.groupBy("label", "d", "shard", "part").cogroup(asked.groupBy("label", "d", "shard", "part")).applyInPandas(
        query, "id long, n long, root long, beam long, links long, missed long"
    )
    found = saved(found, "links")
    audits = [F.max("beam").alias("beam"), F.sum("links").alias("audit_links"), F.sum("missed").alias("audit_missed")]
    counts = found.groupBy("id").agg(F.sum("n").alias("n"), *audits).withColumnRenamed("id", "rep")
    comps = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    discard(index, parts, dealt)
    per_group = groups.join(counts, "rep", "left").join(comps, groups["rep"] == comps["node"], "left")
    per_group = per_group.select(
        "label", "x", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
        *AUDITED
    )
    each = live.join(per_group, ["label", "x"]).select(F.col("id").alias("_id"), "n_links", "component_id", *AUDITED)
    out = vectors.select(F.col(key)).join(each, F.col(key) == F.col("_id"), "left")
    component = F.coalesce("component_id", F.col(key))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        key, number("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"),
        *map(number, AUDITED)
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, labels alike, cosine 0.93: vec_id, n_links, component_id, kept, beam, audit_links, audit_missed."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_near_dedup": op8_embedding_near_dedup}
ORACLES: dict[str, str] = {}
