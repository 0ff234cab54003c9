"""What the operators of this subpackage share: Python on executors, tables that cut lineage, components."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of texts that cross to Python at once, and that are worked on at once.
BATCH_ROWS, SLICE_ROWS = 2000, 500
#: Only used by local masters, where ``spark.checkpoint.dir`` is unset (tests).
LOCAL_WORK_DIR = "/tmp/checkpoints/meshlytics"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers that share this machine import the package (a cluster gets it by ``--py-files``), and keeps the
    batches that cross to them small, since rows hold whole texts: results are lazy, so the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` stays lowered to ``BATCH_ROWS``."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``), which only local masters may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or LOCAL_WORK_DIR
    return f"{base.rstrip('/')}/meshlytics-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there and lost executors cost nothing."""
    folder = work_dir(df.sparkSession)
    df.write.parquet(f"{folder}/{name}")
    release()  # what the driver has held while it fitted or planned
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.saved_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``saved`` wrote and that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(table.saved_in)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def byte_slices(column: pa.Array, most: int):
    """(start, end) of runs of rows of a string column that hold up to ``most`` bytes, or one longer row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    low = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > low and total + n > most:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: Marks that often stand behind a word.
MARKS = ".,"


def word_ids(words: pa.DictionaryArray, marks: np.ndarray, ids_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all ``words`` in a row, where each one's begin (and the last one's end), and its place in the list of
    different words that ``ids_of`` was given, which returns the ids of each as little-endian bytes.

    A mark behind an ASCII letter counts as a token of its own, ``marks`` has its id behind a 0; no others are cut off.
    """
    at, written = np.asarray(words.indices), words.dictionary
    mark = np.select([np.asarray(pc.match_substring_regex(written, f"[A-Za-z][{c}]\\z")) for c in MARKS], [1, 2])
    stems = pc.if_else(pc.greater(pa.array(mark), 0), pc.utf8_slice_codeunits(written, 0, -1), written).dictionary_encode()
    stem = np.asarray(stems.indices)[at]
    raw = ids_of(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    own, mark = sizes[stem], mark[at]
    ends = np.concatenate([[0], np.cumsum(own + (mark > 0))])
    ids, marked = np.zeros(ends[-1], "<u4"), mark.nonzero()[0]
    places = ends[marked + 1] - 1
    rest = np.ones(len(ids), bool)
    rest[places] = False
    ids[places] = marks[mark[marked]]
    ids[rest] = gathered(np.frombuffer(b"".join(raw), "<u4"), (np.cumsum(sizes) - sizes)[stem], own)
    return ids, ends, stem


#: Each byte of UTF-8 text as part of a word: A-Z in lower case, other ASCII that is no letter or digit as 0.
WORD_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all ``texts`` in a row (maximal runs of ASCII letters, digits and other characters than ASCII, A-Z in
    lower case; null has none), how many words stand before each text (and in all), and each word's first byte and the byte
    behind it in its text, as an array of two columns."""
    texts = pc.fill_null(texts, "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    folded = WORD_BYTES[raw]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(raw))]  # a text's end is a word's end
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(folded[inside]))
    before = np.searchsorted(starts, bounds)
    own = np.repeat(bounds[:-1], np.diff(before))
    return words, before, np.stack([starts - own, ends - own], 1)


def release() -> None:
    """Gives free memory back to the system, where its C library can: workers live on after a task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores behind them as far as columns in ``taken`` (Spark ignores case) have them."""
    used = {c.lower() for c in taken}
    tail = ""
    while any((x + tail).lower() in used for x in names):
        tail += "_"
    return [x + tail for x in names]


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those named like ``names``, whatever their case: results replace these."""
    gone = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in gone]


def map_batches(df: DataFrame, fn, schema: T.StructType, forget=None) -> DataFrame:
    """``fn``: from a RecordBatch to the columns of ``schema`` as Arrow arrays, batch by batch. ``forget`` is called when a task
    has ended: it drops what ``fn`` has kept, since the worker lives on for other operators' tasks."""
    ship(df.sparkSession)
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fn(batch.slice(low, SLICE_ROWS))], names
                )
            release()
        if forget is not None:
            forget()
            release()

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, fn, fields: list[T.StructField], reads: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and the columns ``fields`` that ``fn`` makes from the columns ``reads`` of each batch.

    A column of ``df`` with the name of a new one is replaced; columns in ``drop`` are read but not returned.
    """
    stays = set(without(df, *[f.name for f in fields], *drop))
    kept = [f for f in df.schema.fields if f.name in stays]
    places = {f.name: k for k, f in enumerate(df.schema.fields)}
    at, asked = [places[f.name] for f in kept], [places[x] for x in reads]

    def add(batch):
        return [batch.column(k) for k in at] + fn(*[batch.column(k) for k in asked])

    return map_batches(df, add, T.StructType([*kept, *fields]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges`` (long ids): ``node``, ``component`` = the smallest id reachable.

    Large-star and small-star steps in turn (Kiveris and others, 2014). Each step groups edges by a node and takes
    only the node's minimum, which Spark aggregates before the shuffle, so a node with very many edges is no hot
    task. Every step is a written table, the result too. No edges: no rows. Null ends and loops are passed over.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = saved(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        old, e = e, saved(small.where("u <> v").distinct(), "edges")
        discard(old)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = saved(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(e)
    return out


class Memo:
    """A bounded cache: the words seen lately and their values. Two generations; when the young one is full it ages."""

    def __init__(self, compute, limit: int = 200_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def fill(self, keys) -> dict:
        """A dict that holds every key of ``keys`` (a list or set), which should be far fewer than the limit."""
        young = self.young
        if missing := [k for k in keys if k not in young]:
            if len(young) + len(missing) > self.limit:
                self.old, self.young = young, {}
                young, missing = self.young, list(keys)
            old = self.old
            new = []
            for k in missing:
                if (v := old.get(k)) is None:
                    new.append(k)
                else:
                    young[k] = v
            if new:
                young.update(zip(new, self.compute(new)))
        return young

    def clear(self) -> None:
        self.young, self.old = {}, {}
