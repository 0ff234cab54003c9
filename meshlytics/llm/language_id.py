"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to a fixed number of slots. The model is trained
with the follow-the-regularised-leader proximal rule and elastic-net penalties (McMahan and others, 2013), then one
temperature is fitted on rows kept apart. Languages and document frequencies are those of all labelled rows that have a
letter. Weights are fitted on at most ``sample`` of these rows, of each language those of least key hash: in proportion,
but a quarter of the sample is dealt evenly, so that rare languages are learnt too (with more languages than fit, one row
each). Counting is a Spark job, only sums and the sample's counts come to the driver. Prediction runs over all rows and
whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that is first
in order; without labelled rows every text is ``und``; repeated rows get the same result; very long texts are one count
each; an empty table gives no rows; other columns stay, but for those named like the results.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, read_table, release, ship, with_columns

SLOTS = 1 << 15
#: The most labelled rows that the model is fitted on; every fourth of them only for the temperature.
SAMPLE = 4000
UNKNOWN = "und"


def counts(text: str, slots: int = SLOTS) -> np.ndarray | None:
    """How often each slot's n-grams occur; None without a letter."""
    low = text.lower()
    if not any(map(str.isalpha, low)):
        return None
    # White space of any length is one separator; digits and signs are left out, so that they are no evidence.
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = (c < 0x80) & ((c < 0x61) | (c > 0x7A))
    c = np.where(plain, np.uint32(32), c)
    if len(c) > 1:
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    keys = np.concatenate(
        [
            c[1:-1] * np.uint32(0xC2B2AE35) + np.uint32(1), two * np.uint32(0x27D4EB2F) + np.uint32(2),
            three * np.uint32(0x165667B1) + np.uint32(3)
        ]
    )
    keys ^= keys >> np.uint32(15)
    keys *= np.uint32(0x2C1B3C6D)
    return np.bincount(keys >> np.uint32(32 - slots.bit_length() + 1), minlength=slots)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages, already times the inverse document frequency
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text, len(self.idf)) if text is not None and self.languages else None
        if n is None:
            return UNKNOWN, 0.0
        at = n.nonzero()[0]
        tf = np.log1p(n[at])
        z = tf @ self.weights[at] / max(np.linalg.norm(tf * self.idf[at]), 1e-12) + self.bias
        p = np.exp((z - z.max()) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], slots: int, languages: int, passes: int = 4, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.05, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x languages) and biases from rows of slots, values and class."""
    z, n = np.zeros((slots + 1, languages)), np.zeros((slots + 1, languages))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(passes):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / alpha * w
            n[at] += squares
    w = weights(np.arange(slots + 1))
    return w[:-1], w[-1]


def document_frequencies(texts: DataFrame, slots: int) -> tuple[np.ndarray, int]:
    """In how many of the texts with a letter each slot occurs, and how many such texts there are (both over all rows)."""
    ship(texts.sparkSession)

    def add(batches):
        seen = np.zeros(slots + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                if (n := counts(t.as_py(), slots)) is not None:
                    seen[:-1] += n > 0
                    seen[-1] += 1
            release()
        at = seen.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["slot", "n"])

    sums = texts.mapInArrow(add, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(slots + 1)
    for r in sums:
        seen[r["slot"]] = r["n"]
    return seen[:-1], int(seen[-1])


def quotas(sizes: list[int], sample: int) -> list[int]:
    """How many rows of each language are sampled: all if they fit, else a quarter evenly and the rest in proportion."""
    total = sum(sizes)
    if total <= sample:
        return sizes
    even = sample // (4 * len(sizes))
    rest = sample - even * len(sizes)
    return [min(n, max(1, even + rest * n // total)) for n in sizes]


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, slots: int = SLOTS
) -> Model:
    """The model of the rows of ``labelled`` that have a text and a language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(key).cast("string").alias("k"), F.col(lang).alias("y"), F.col(text).alias("t")
    )
    seen, total = document_frequencies(rows.select("t"), slots)
    # First the hashes alone, then the texts of the least ones: no task holds more texts than it returns.
    rows = rows.withColumn("h", F.xxhash64("k", "t"))
    hashes = rows.select("y", "h").distinct()
    known = {r["y"]: r["n"] for r in hashes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not known:
        return Model([], np.zeros((slots, 0)), np.zeros(slots), np.zeros(0), 1.0)
    quota = labelled.sparkSession.createDataFrame(
        [(y, n, q) for (y, n), q in zip(known.items(), quotas(list(known.values()), sample))], "y string, all long, quota long"
    )
    # Hashes are even, so about a quota of each language is under its share; these few are ranked.
    share = (F.col("quota") + 6 * F.sqrt("quota") + 40) / F.col("all")
    under = (F.col("quota") == F.col("all")) | (F.col("h").cast("double") < (F.least(F.lit(1.0), share) - 0.5) * 2.0**64)
    least = hashes.join(F.broadcast(quota), "y").where(under).withColumn(
        "rank", F.row_number().over(Window.partitionBy("y").orderBy("h"))
    ).where("rank <= quota").select("y", "h")
    rows = rows.join(F.broadcast(least), ["y", "h"]).dropDuplicates(["y", "h"]).select("k", "y", "t")

    def sparse(text):
        """The slots and their counts as bytes; a count of all slots is held for one text at a time."""
        if (n := counts(text, slots)) is None:
            return None, None
        at = n.nonzero()[0]
        return at.astype("<u4").tobytes(), n[at].astype("<u4").tobytes()

    def count(batch):
        found = [sparse(t.as_py()) for t in batch.column(2)]
        return [batch.column(1), *[pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]]

    schema = T.StructType([T.StructField("y", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    got = [
        (
            r["y"], np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(float)
        ) for r in map_batches(rows, count, schema).collect() if r["at"] is not None
    ]
    got.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))  # the order of arrival must not matter
    languages = sorted({y for y, _, _ in got})
    if not languages:
        return Model([], np.zeros((slots, 0)), np.zeros(slots), np.zeros(0), 1.0)
    idf = np.log((1 + total) / (1 + seen)) + 1
    vectors, fourth, of = [], [], Counter()
    for y, at, n in got:
        x = np.log1p(n) * idf[at]
        vectors.append((np.append(at, slots), np.append(x / max(np.linalg.norm(x), 1e-12), 1.0), languages.index(y)))
        fourth.append(of[y] % 4 == 3)  # by language: each one's first rows are learnt from
        of[y] += 1
    apart = [v for v, f in zip(vectors, fourth) if f] or vectors
    w, bias = ftrl([v for v, f in zip(vectors, fourth) if not f], slots, len(languages))
    z = np.array([x[:-1] @ w[at[:-1]] + bias for at, x, _ in apart])
    truth = np.array([y for _, _, y in apart])

    def loss(t):
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), truth]).mean())

    temperature = min(np.geomspace(0.05, 5, 81), key=loss)
    return Model(languages, (w * idf[:, None]).astype(np.float32), idf.astype(np.float32), bias, float(temperature))


def identify(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, a calibrated probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded table of weights

    def add(texts):
        found = [shared.value.predict(t.as_py()) for t in texts]
        return [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]

    return with_columns(
        docs, add, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], [text],
        drop=(text,) if drop_text else ()
    )


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score; learnt from rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(
        docs.select("doc_id", held_out().alias("held_out"), "text"), model, drop_text=True
    ).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
