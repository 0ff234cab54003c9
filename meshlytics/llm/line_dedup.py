"""Line dedup by site-relative frequency, in DataFrame operations only.

A line of a host is boilerplate when the pages of that host that hold it are more than ``max_ratio`` of the host's
pages and at least ``min_pages``. Lines are compared without spaces at their ends. Only 64-bit line hashes are
shuffled, counted before the shuffle; texts stay where they are, unless the table of boilerplate lines is too large
for Spark to broadcast. Then a host that has more than one in ``HOT`` of all pages, so at most that many hosts, is
joined in parts. A host's boilerplate lines are at most its mean lines a page over ``max_ratio``.

Defined results: a null text stays null with null counts; a null host belongs to no site, so its pages keep all lines;
blank lines are kept and not counted; a repeated row is a page of its own, so the lines of a text whose copies are more
than the ratio of their host's pages are all dropped, from each copy; a line at exactly the ratio stays; a page all of
whose lines go has the empty text; very long texts are ordinary: a page's boilerplate lines are dealt to lists by hash, about
as many as the root of their number, so that a line is looked up in one short list; an empty table gives no rows; all other
columns stay, but for those named like the results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read_table, saved, without

MAX_RATIO, MIN_PAGES = 0.1, 5
#: Hosts with more than one in so many of all pages are joined in parts, as far as their lines are copied to no more rows
#: than these (it is about where pages are joined, not which).
HOT, COPIED = 1000, 2_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _dealt(hashes: Column) -> Column:
    """An array of hashes dealt to as many arrays as the root of its size, so that dealing and finding cost that much each."""
    many = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(hashes)))).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda k: F.filter(hashes, lambda h: F.pmod(h, many) == k))


def _among(lists: Column, line: Column) -> Column:
    return F.array_contains(F.get(lists, F.pmod(line, F.size(lists)).cast("int")), line)


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host``, ``pages`` (how many it has) and ``drop``, the hashes of its boilerplate lines; hosts without any are left out."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where(F.col("host").isNotNull())
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _hash))
    counts = pages.select(
        "host", F.explode(hashes).alias("line")
    ).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = counts.join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return frequent.groupBy("host", "pages").agg(F.collect_list("line").alias("drop"))


def dedup_lines(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``n_lines`` and ``n_dropped`` long."""
    names = ("_host", "_part", "_parts", "_drop", "_gone", "_lists", "_kept")
    of, part, parts, drop, gone, lists, kept = free_names(docs.columns, *names)
    found = saved(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    total = found.agg(F.max("pages")).first()[0] and docs.where(F.col(host).isNotNull()).count()
    share = F.ceil(F.col("pages") * HOT / F.lit(total or 1))
    found = found.withColumn("parts", F.greatest(F.lit(1), F.least(share, F.floor(F.lit(COPIED) / F.size("drop")))).cast("int"))
    hot = found.where("parts > 1").select(F.col("host").alias(of), F.col("parts").alias(parts))  # HOT rows at most
    dealt = found.select(
        F.col("host").alias(of), F.col("drop").alias(drop), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(part)
    )
    pages = docs.select(*without(docs, "n_lines", "n_dropped"))
    stay = pages.columns
    pages = pages.join(F.broadcast(hot), pages[host] == hot[of], "left").drop(of)
    pages = pages.withColumn(part, F.pmod(F.xxhash64(text), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    marked = pages.join(dealt, (pages[host] == dealt[of]) & (pages[part] == dealt[part]), "left")
    all_lines = _lines(F.col(text))
    # The page's own boilerplate first, dealt to lists by hash, so that each line is looked up among few. Both are columns that
    # are read more than once, so Spark computes them once a row.
    marked = marked.withColumn(gone, F.array_intersect(F.transform(all_lines, _hash), drop))
    marked = marked.withColumn(lists, F.when(F.col(gone).isNotNull(), _dealt(F.col(gone))))
    stays = F.filter(all_lines, lambda x: (F.trim(x) == "") | ~_among(F.col(lists), _hash(x)))
    marked = marked.withColumn(kept, F.when(F.col(lists).isNull(), all_lines).otherwise(stays))
    out = [F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in stay]
    n = F.size(all_lines).cast("long")
    return marked.select(
        *out, F.when(F.col(text).isNotNull(), n).alias("n_lines"), F.when(F.col(text).isNotNull(), n - F.size(kept)).alias("n_dropped")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their source as host: doc_id, text, n_lines, n_dropped."""
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT rn, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rn, doc_id, source, text FROM documents)
), counts AS (
  SELECT source, trim(line) AS line, count(DISTINCT rn) AS n FROM lines WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY 1, 2
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
boiler AS (SELECT c.source, c.line FROM counts c JOIN totals t USING (source) WHERE n > {MAX_RATIO} * pages AND n >= {MIN_PAGES}),
marked AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source = b.source AND trim(l.line) = b.line
)
SELECT min(doc_id) AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped
FROM marked GROUP BY rn
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL
"""
}
