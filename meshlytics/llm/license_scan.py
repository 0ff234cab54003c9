"""Licence scan by canonical digest, in DataFrame operations only.

A text's canonical form: lower case, spellings made alike, punctuation as spaces, copyright lines ("Copyright (c) ...",
"Copyright 2020 ...", "All rights reserved.") left out, runs of white space as one space, so that holders, years, and
where lines break make no difference. The digest of the whole form is joined to the digests of known licences: the texts
in ``licences``, with and without their titles, list numbers and appendices. Each line's own digest is looked up too, for
notices that stand as a line of a longer text. The known table is some dozens of rows, so the join needs no shuffle.

Defined results: a null text has null digest, no licence and no notices; an empty text (or one that only has copyright
lines) has the digest of the empty form, which no licence has; where two licences had one digest, the first by name is
given; repeated rows are scanned each; very long texts are ordinary; an empty table gives no rows; other columns stay,
but for those named like the results.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read_table, without

#: Spellings that count as alike, replaced in this order. Fixed values.
ALIKE = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("holder", "owner"),
    ("noninfringement", "non infringement"),
    ("http:", "https:"),
]
#: And words in two that are one, when punctuation and line ends are spaces.
SPLIT, WHOLE = "sub license", "sublicense"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\f\v\xa0 ‘’“”–—"
#: A line is left out when its canonical form begins or is so.
COPYRIGHT, RESERVED = "^(c )?copyright (c |© ?|[0-9])|^©", "all rights reserved"

#: Usual notices of one line. Fixed values.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Titles that may stand above a text. Fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense",),
}
#: After this line only advice on how to use a licence follows.
TERMS_END = "END OF TERMS AND CONDITIONS"


def known_texts(folder: Path = Path(__file__).with_name("licences")) -> list[tuple[str, str]]:
    """(licence, text) of the files in ``folder``, each as it is and in the forms in which it is usually copied."""
    out = []
    for file in sorted(folder.glob("*.txt")):
        name, text = file.stem.removesuffix("-header"), file.read_text()
        forms = [text, *(f"{title}\n{text}" for title in TITLES.get(file.stem, ()))]
        if file.stem.startswith(("BSD", "Zlib")):
            forms += [re.sub(r"(?m)^[0-9]\. ", "", x) for x in forms]
        if TERMS_END in text:
            forms.append(text[: text.index(TERMS_END)])
            forms.append(forms[-1] + TERMS_END)
        out += [(name, x) for x in forms]
    return out


#: Known licences and notices.
KNOWN = [*NOTICES, *known_texts()]


def canonical_lines(text: Column) -> Column:
    """The canonical forms of the lines that count."""
    alike = F.lower(text)
    for a, b in ALIKE:
        alike = F.replace(alike, F.lit(a), F.lit(b))
    plain = F.translate(alike, PUNCTUATION, " " * len(PUNCTUATION))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, " {2,}", " ")))
    return F.filter(lines, lambda x: ~x.isin("", RESERVED) & ~x.rlike(COPYRIGHT))


def digest_of(form: Column) -> Column:
    return F.sha2(F.replace(form, F.lit(SPLIT), F.lit(WHOLE)), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``license`` and ``digest``, one row per digest."""
    table = spark.createDataFrame(known, "license string, _known string")
    return table.select(
        "license", digest_of(F.array_join(canonical_lines(F.col("_known")), " ")).alias("digest")
    ).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text", known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``docs`` with ``digest`` (of the whole text), ``license`` (the known text it is, or null) and ``notices`` (licences
    that single lines are, comma-joined in order of their names)."""
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    names = without(docs, "digest", "license", "notices")
    (lines,) = free_names(docs.columns, "_lines")
    rows = docs.select(*names, canonical_lines(F.col(text)).alias(lines))
    # The known list is part of the code, so its digests make a literal.
    table = F.create_map(*[F.lit(x) for row in digests.collect() for x in (row["digest"], row["license"])])
    found = F.array_sort(
        F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(table, digest_of(x))), lambda x: x.isNotNull()))
    )
    rows = rows.withColumns({"notices": F.array_join(found, ","), "digest": digest_of(F.array_join(lines, " "))})
    return rows.drop(lines).join(F.broadcast(digests), "digest", "left").select(*names, "digest", "license", "notices")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, digest, license, notices."""
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql_lines(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for a, b in [("", "")] + ALIKE:
        text = f"replace({text}, {quoted(a)}, {quoted(b)})" if a else f"lower({text})"
    plain = f"translate({text}, {quoted(PUNCTUATION)}, {quoted(' ' * len(PUNCTUATION))})"
    lines = f"list_transform(string_split({plain}, chr(10)), lambda x: trim(regexp_replace(x, ' {{2,}}', ' ', 'g')))"
    return f"list_filter({lines}, lambda x: x NOT IN ('', {quoted(RESERVED)}) AND NOT regexp_matches(x, {quoted(COPYRIGHT)}))"


def _sql_digest(form: str) -> str:
    return f"sha256(replace({form}, '{SPLIT}', '{WHOLE}'))"


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {
    "op6_license_scan": f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, {_sql_digest(f"array_to_string({_sql_lines('t')}, ' ')")} AS digest
    FROM (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN)}) v(license, t)) GROUP BY 1
), forms AS (SELECT row_number() OVER () AS rn, doc_id, {_sql_lines("text")} AS ls FROM documents),
notices AS (
  SELECT rn, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT rn, {_sql_digest("unnest(ls)")} AS digest FROM forms) JOIN known USING (digest) GROUP BY 1
), whole AS (SELECT rn, doc_id, {_sql_digest("array_to_string(ls, ' ')")} AS digest, ls FROM forms)
SELECT w.doc_id, w.digest, k.license, CASE WHEN w.ls IS NOT NULL THEN coalesce(n.notices, '') END AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (rn)
"""
}
