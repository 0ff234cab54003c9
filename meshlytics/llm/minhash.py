"""Near-duplicate texts by bottom-k sketches of one hash function.

A text's set is its distinct word shingles, each a 64-bit hash; its sketch is the ``k`` smallest. Texts with equal sets
are one node from then on. Inverted lists hold which nodes retain a value. Of each node only the values that are
rarest among all nodes are listed: two sets as similar as asked for share more values of their sketches than the rest
could hold, so they meet in a list (for sets that fit a sketch by count, for larger ones but for a chance of 2e-7 at the threshold, less above; with the
estimates of both sizes of sketches, a link is lost with a chance below 1e-6 in all).

Lists are worked through without making all their pairs: each list first compares its members to one hub; links are
verified on the full sets and joined to components. Short lists whose members still differ in component are compared
pair by pair. The nodes of such long lists are listed anew by sketches of ``WIDE`` values, which leaves out those that
only share frequent passages; after ``ROUNDS`` more of hubs, what is still apart is compared in blocks of bounded size.
A block returns a forest of the pairs that may be links, so its rows follow its members; the texts of each tree then
meet once more in blocks, where the pairs across components are verified. Pairs pass if the sketch of their union
estimates a similarity near enough, and are confirmed on the full sets.

Defined results: a text without words, or null, has an empty set and links with nothing; a null id is returned as a
component of its own (null) that is kept; rows that share an id are one node, each is returned; of equal texts the
smallest id stands for all; a pair at exactly the threshold is a link; ids may be of any type that has an order; very
long texts are ordinary, memory goes with the texts of one block; an empty table gives no rows; other columns, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, map_batches, read_table, saved, ship

#: Values that a sketch retains.
K = 64
#: And those of the nodes that are in long lists.
WIDE = 512
#: Rounds of hubs before blocks.
ROUNDS = 1
#: Members of a block, about, and of a block of whole texts; lists up to SMALL are compared pair by pair.
BLOCK, TEXT_BLOCK, SMALL = 512, 64, 16
#: The chance that a pair at exactly the threshold shares too few values to meet in a list, and that its estimate is too
#: low, with sketches of either size; smaller for any pair above. In all below 1e-6.
LOST_IN_LISTS, LOST_BY_ESTIMATE = 2e-7, 1e-9
#: Partners of a node that are verified in one run, about.
RUN = 256


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text: sorted distinct hashes. ASCII letters in lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    count = len(w) - size + 1
    h = np.full(count, size, np.uint64)
    for j in range(size):
        h = (h ^ x[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def sketches(docs: DataFrame, key: str, text: str, words: int, k: int = K) -> DataFrame:
    """``id``, ``n`` (size of the set), ``fp`` (of the whole set; null if empty) and ``sketch``."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.StringType()),
            T.StructField("sketch", T.ArrayType(T.LongType()))
        ]
    )

    def make(batch):
        from xxhash import xxh3_128_hexdigest

        n, fp, parts = [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py(), words)
            n.append(len(s))
            fp.append(xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            parts.append(s[:k].view(np.int64).copy())  # a view would keep the whole set
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return [
            batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
        ]

    return map_batches(docs.select(F.col(key).cast("long"), text), make, schema)


@functools.cache
def least_of_sketch(k: int, percent: int, chance: float) -> int:
    """Of ``k`` values of the union's sketch each is in both sets with the sets' similarity. The largest number that the
    values in both of similar sets stay below with a chance of at most ``chance``: the exact binomial tail."""
    t, total, n = percent / 100, 0.0, 0
    while n < k:
        total += math.exp(
            math.lgamma(k + 1) - math.lgamma(n + 1) - math.lgamma(k - n + 1) + n * math.log(t) + (k - n) * math.log1p(-t)
        ) if t < 1 else 0.0
        if total > chance:
            break
        n += 1
    return n


def shared_at_least(k: int, percent: int) -> int:
    """Values that the sketches of two similar sets share, but for a chance of ``LOST_IN_LISTS``."""
    return max(1, least_of_sketch(k, percent, LOST_IN_LISTS))


def rare_postings(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """``v`` and ``id``: of each node the rarest values of its sketch, as many as similar sketches can't do without."""
    postings = nodes.select("id", "n", F.explode("sketch").alias("v"))
    common = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = postings.join(common, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    n, size = F.col("n"), F.least(F.col("n"), F.lit(k))
    whole = n - F.ceil(n * percent / 100) + 1
    prefix = F.when(n * 100 <= k * percent, whole).otherwise(size - shared_at_least(k, percent) + 1)
    take = F.least(prefix - (size - F.size("held")), F.size("held")).cast("int")  # values that one node alone retains come first
    return held.where(take > 0).select(
        "id", "n", F.explode(F.slice("held", F.lit(1), take)).alias("h")
    ).select("id", "n", F.col("h.v").alias("v"))


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int) -> float:
    """The similarity by the sketch of the union; exact where both sketches are whole sets."""
    if na <= k and nb <= k:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (na + nb - both)
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(union, both, assume_unique=True).sum() / len(union)


def near_enough(k: int, percent: int) -> float:
    """The least estimate that is verified; similar sets stay below it with a chance of ``LOST_BY_ESTIMATE``."""
    return least_of_sketch(k, percent, LOST_BY_ESTIMATE) / k


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose estimate is near enough."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    rows = rows.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    least = near_enough(k, percent)

    def keep(batch):
        a, b, na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b", "na", "nb"))
        sa, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("sa", "sb"))
        ok = [
            i for i in range(len(a)) if estimate(
                sa[i].values.to_numpy().view(np.uint64), sb[i].values.to_numpy().view(np.uint64), na[i], nb[i], k
            ) >= least
        ]
        return [pa.array(a[ok]), pa.array(b[ok])]

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return map_batches(rows, keep, schema)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked for. ``texts``: ``id`` and ``text`` of all nodes that occur.

    A node with many pairs is dealt to runs of about ``RUN``; its text goes once to each run, before its partners' texts.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    left, right = texts.select(F.col("id").alias("a"), "text"), texts.select(F.col("id").alias("b"), "text")
    heads = runs.join(left, "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"),
        "text"
    )
    rest = pairs.join(runs, "a").withColumn("run", F.pmod(F.xxhash64("b"), "runs").cast("int"))
    rest = rest.join(right, "b").select("a", "run", F.lit(1).alias("role"), "b", "text")
    rows = heads.unionByName(rest).repartition("a", "run").sortWithinPartitions("a", "run", "role")
    ship(rows.sparkSession)

    def keep(batches):
        at, heads = None, []
        for batch in batches:
            out = []
            for a, run, role, b, text in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                if (a, run) != at:
                    at, heads = (a, run), []
                own = shingles(text.as_py(), words)
                if not role:
                    heads.append(own)  # several if rows share the id
                elif any(similar(x, own, percent) for x in heads):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(keep, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def hub_pairs(postings: DataFrame, number: int) -> DataFrame:
    """Each member with its list's hub: the smallest id in the first round, in later ones the least of a hash."""
    rank = F.col("id") if number == 0 else F.struct(F.xxhash64("id", "v", F.lit(number)), "id")
    hubs = postings.groupBy("v").agg((F.min(rank) if number == 0 else F.min(rank)["id"]).alias("hub"))
    pairs = postings.join(hubs, "v").where("id <> hub")
    if number:
        hub_comp = postings.select(F.col("v"), F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
        pairs = pairs.join(hub_comp, ["v", "hub"]).where("comp <> hub_comp")  # a row per list: no list is multiplied
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def still_apart(postings: DataFrame, links: DataFrame, compared: bool = True) -> DataFrame:
    """The postings with their components, of the lists that hold several. Lists of two are left out where hubs have
    ``compared`` the members of these lists: their one pair is done."""
    comps = components(links)
    now = postings.join(comps, postings["id"] == comps["node"], "left").select("v", "id", "n", F.coalesce("component", "id").alias("comp"))
    open_lists = now.groupBy("v").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")
    ).where(f"lo <> hi and size > {2 if compared else 1}").select("v", "size")
    out = saved(now.join(open_lists, "v"), "apart")
    discard(comps)
    return out


def small_pairs(apart: DataFrame) -> DataFrame:
    """The pairs across components of the lists of up to ``SMALL`` members."""
    small = apart.where(F.col("size") <= SMALL)
    x = small.select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = small.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()


def overlaps(sketches: list[np.ndarray]) -> np.ndarray:
    """How many values each two sketches share: a product of their 0/1 rows over the values that occur twice."""
    values, inverse, counts = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    rows, cols = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches]), place[inverse]
    out = np.zeros((len(sketches), len(sketches)), np.float32)
    for low in range(0, len(common), 4096):
        own = (cols >= low) & (cols < low + 4096)
        m = np.zeros((len(sketches), min(4096, len(common) - low)), np.float32)
        m[rows[own], cols[own] - low] = 1
        out += m @ m.T
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the symmetric relation ``near``."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        todo = [start] * bool(left[start])
        left[start] = False
        while todo:
            v = todo.pop()
            found = np.flatnonzero(near[v] & left)
            left[found] = False
            out += [(v, y) for y in found.tolist()]
            todo += found.tolist()
    return out


def promising(
    ids: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: list[np.ndarray], k: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs across components are links for sure (both sketches are whole sets), and which may be, by the values
    that their sketches share."""
    both, small, large = overlaps(sketches), np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    apart = (comp[:, None] != comp[None, :]) & (ids[:, None] != ids[None, :]) & (small * 100 >= large * percent)
    sure = apart & (large <= k) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
    return sure, apart & (large > k) & (both >= np.minimum(shared_at_least(k, percent), small))


def in_blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``rows`` (``group``, ``id``, ``comp`` and others) dealt to blocks ``i``, ``j`` of up to about twice ``size`` rows, so that
    each two rows of a group and of different components meet in one. Of a group's largest component no block pairs
    are made: its rows only meet those of the others."""
    comps = rows.groupBy(group, "comp").agg(F.count("*").alias("c"))
    shape = comps.groupBy(group).agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
    shape = shape.select(
        group, F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.c")) / size).cast("int").alias("rest_blocks"),
        F.ceil(F.col("main.c") / size).cast("int").alias("main_blocks")
    )
    dealt = rows.join(shape, group)
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.col("rest_blocks") + F.pmod(F.xxhash64("id"), "main_blocks")).otherwise(F.pmod(F.xxhash64("id"), "rest_blocks"))
    others = F.when(is_main, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks"))
    dealt = dealt.where("rest_blocks > 0").withColumn("own", own.cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), others - 1))
    )
    return dealt.withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
    ).drop("main", "rest_blocks", "main_blocks", "own", "other")


def block_links(apart: DataFrame, nodes: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Of each block of a long list a forest of its links that are ``sure``, and one of the pairs that may be links: as many
    rows as members at most, however many pairs there are."""
    ship(apart.sparkSession)
    large = apart.where(F.col("size") > SMALL).select("v", "id", "comp")
    dealt = in_blocks(large, "v", block).join(nodes.select("id", "n", "sketch"), "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, comp = (pdf[c].to_numpy() for c in ("id", "n", "comp"))
        sure, maybe = promising(ids, n, comp, [np.asarray(x) for x in pdf["sketch"]], k, percent)
        rows = [(min(ids[p], ids[q]), max(ids[p], ids[q]), flag) for near, flag in ((sure, True), (maybe, False)) for p, q in forest(near)]
        return pd.DataFrame(rows, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": bool})

    return dealt.groupBy("v", "i", "j").applyInPandas(compare, "a long, b long, sure boolean").distinct()


def cluster_links(
    maybe: DataFrame, links: DataFrame, texts: DataFrame, words: int, k: int, percent: int, block: int = TEXT_BLOCK
) -> DataFrame:
    """The links among the pairs that may be some, of which ``maybe`` is a forest: its trees' texts meet in blocks, where each
    promising pair across components is compared on full sets until its components are joined."""
    trees = components(maybe).select(F.col("node").alias("id"), F.col("component").alias("tree"))
    comps = components(links)
    members = saved(
        trees.join(comps, trees["id"] == comps["node"], "left").select("tree", "id", F.coalesce("component", "id").alias("comp")), "trees"
    )
    dealt = in_blocks(members, "tree", block).join(texts, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        sets = [shingles(t, words) for t in pdf["text"]]
        sure, maybe = promising(ids, np.array([len(x) for x in sets]), comp, [x[:k].view(np.int64) for x in sets], k, percent)
        root, out = {c: c for c in comp.tolist()}, []

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for p, q in np.argwhere(np.triu(sure | maybe)).tolist():
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a == b or estimate(sets[p][:k], sets[q][:k], len(sets[p]), len(sets[q]), k) < near_enough(k, percent):
                continue
            if similar(sets[p], sets[q], percent):
                root[a] = b
                out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("tree", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, k: int = K, rounds: int = ROUNDS
) -> DataFrame:
    """A row per row of ``docs``: ``key``, ``n_shingles``, ``component_id`` (the smallest key reachable by links) and
    ``kept``. Links: sets of ``words``-word shingles, 100 * shared >= ``percent`` * all of both."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return by_hash(docs, key, text, words, percent, k, rounds)
    rows = saved(sketches(docs, key, text, words, k), "sketches")
    live = rows.where(F.col("id").isNotNull() & F.col("fp").isNotNull())
    first = saved(live.groupBy("fp").agg(F.min("id").alias("id")), "first")
    links, scratch = linked(
        docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), live.join(first, ["fp", "id"]), words, percent, k,
        rounds
    )
    comps = components(links)
    discard(*scratch)
    same = rows.join(first.select("fp", F.col("id").alias("first")), "fp", "left")
    out = same.join(comps, same["first"] == comps["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "first", "id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def by_hash(docs: DataFrame, key: str, text: str, *how) -> DataFrame:
    """``near_duplicates`` for keys that are no whole numbers: by their hashes, each component then named by its least key."""
    ids = docs.select(F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("id"), F.col(key).alias("name"), F.col(text).alias("text"))
    found = saved(near_duplicates(ids.select("id", "text"), "id", "text", *how), "by_hash")
    names = ids.select("id", "name").where("id is not null").distinct()
    least = found.select("id", "component_id").distinct().join(names, "id").groupBy("component_id").agg(F.min("name").alias("least"))
    out = found.join(names, "id", "left").join(least, "component_id", "left")
    return out.select(
        F.col("name").alias(key), "n_shingles", F.col("least").alias("component_id"),
        F.coalesce(F.col("name") == F.col("least"), F.lit(True)).alias("kept")
    )


def linked(texts: DataFrame, nodes: DataFrame, words: int, percent: int, k: int, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links ``a``, ``b`` that join all similar nodes (a pair is left out where others join it), and the tables that hold
    them and what led to them. ``texts``: ``id`` and ``text`` of all rows."""
    scratch: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(saved(df, name))
        return scratch[-1]

    def apart_now(compared: bool = True) -> DataFrame:
        scratch.append(still_apart(postings, links, compared))
        return scratch[-1]

    # Rows that share an id are several nodes of one id, so each pair of their texts is tried; links are those of ids.
    def check(pairs: DataFrame, of: DataFrame, size: int) -> DataFrame:
        return keep(verified(estimated(pairs, of, size, percent), texts, words, percent), "links")

    nodes = keep(nodes.select("id", "n", "sketch").dropDuplicates(["id", "n", "sketch"]), "nodes")
    postings = keep(rare_postings(nodes, k, percent), "postings")
    lists = postings.groupBy("v").agg(F.count("*").alias("size")).where("size > 1").select("v")
    postings = keep(postings.join(lists, "v"), "lists")
    texts = keep(texts.join(postings.select("id").distinct(), "id", "left_semi"), "texts")
    links = check(hub_pairs(postings, 0), nodes, k)
    apart = apart_now()
    links = links.unionByName(check(small_pairs(apart), nodes, k))
    hot = keep(apart.where(F.col("size") > SMALL).select("id").distinct(), "hot")
    if hot.isEmpty():
        return links, scratch
    # Nodes of long lists are listed anew by larger sketches, of which fewer values have to be listed.
    wide = keep(sketches(texts.join(hot, "id", "left_semi"), "id", "text", words, WIDE).select("id", "n", "sketch"), "wide")
    postings = keep(rare_postings(wide, WIDE, percent), "postings")
    apart = apart_now(compared=False)
    for number in range(rounds):
        if apart.isEmpty():
            return links, scratch
        links = links.unionByName(check(hub_pairs(apart, number), wide, WIDE))
        apart = apart_now()
    if apart.isEmpty():
        return links, scratch
    links = links.unionByName(check(small_pairs(apart), wide, WIDE))
    found = keep(block_links(apart, wide, WIDE, percent), "blocks")
    links = links.unionByName(found.where("sure").select("a", "b"))
    maybe = found.where("not sure").select("a", "b")
    if maybe.isEmpty():
        return links, scratch
    return links.unionByName(keep(cluster_links(maybe, links, texts, words, WIDE, percent), "links")), scratch


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, similarity 0.85: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLES: dict[str, str] = {}
