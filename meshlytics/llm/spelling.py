"""Groups of spelling variants: near words by asymmetric chunks.

Words are counted over whole texts. Of two words that differ by one code point the shorter (or either of two as long)
gives disjoint chunks, the other positional grams: one edit leaves one of two halves whole, which then stands in the other word
at the same place or one further on. The half that holds the edit is halved again and leaves one of its own halves, so a
key is a word less one quarter; the other word's keys are the grams before and behind that quarter, the latter shifted
by the difference of lengths. Groups of over ``CROWD`` keys are halved on until the part left out is a single code
point; then a group holds at most as many words as there are letters. Joined words are verified by their edit distance.

A word's form is the near word that occurs most often, if it occurs ``RATIO`` times as often as the word; forms are
followed to the last (each step multiplies the count, so there are few).

Defined results: null and empty texts have no words; a null id counts as an empty one; texts of any length are ordinary;
repeated rows count as often as they occur; of near words with the same count the first in code-point order is the
form; a word without near words is its own root; an empty table gives no rows; other columns, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, saved

#: Letters: runs of these are words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its word.
RATIO = 10
#: One run in so many loses a code point.
SPOILT = 31
#: The most keys of a group that is joined; larger ones are split.
CROWD = 200


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``id`` (text) and ``run`` of each run of ``least`` or more letters, A-Z in lower case. Shorter runs never make words."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return each.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))


def spoilt(id_: Column, run: Column, every: int = SPOILT) -> Column:
    """The run, less one code point if ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(id_, F.lit(":"), run))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` (occurrences) of all documents."""
    each = runs(docs, key, text, least).select(spoilt(F.col("id"), F.col("run")).alias("word")).where(F.char_length("word") >= least)
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def keys(rows: DataFrame) -> DataFrame:
    """``rows`` (``word``, ``size`` of the shorter word, ``d`` = 1 if this is a longer one, ``start`` and ``length`` of the part
    that is left out) with ``key``: a hash of what is left, with that part's place."""
    behind = F.col("start") + F.col("length") + F.col("d") + 1
    left = F.concat(F.substring("word", F.lit(1), F.col("start")), F.lit(" "), F.substr("word", behind))
    return rows.withColumn("key", F.xxhash64("size", "start", "length", left))


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the part left out is its first half, or its second."""
    half = F.floor(F.col("length") / 2).cast("int")
    parts = F.array(
        F.struct(F.col("start").alias("s"), half.alias("l")),
        F.struct((F.col("start") + half).alias("s"), (F.col("length") - half).alias("l"))
    )
    return rows.withColumn("part", F.explode(parts)).select(
        "word", "size", "d", F.col("part.s").alias("start"), F.col("part.l").alias("length")
    )


def verified(rows: DataFrame) -> DataFrame:
    """``a``, ``b``: the words of equal keys that differ by one code point; ``a`` is the shorter, or the first of two as long."""
    a = rows.where("d = 0").select("key", F.col("word").alias("a"))
    b = rows.select("key", "d", F.col("word").alias("b"))
    pairs = a.join(b, "key").where((F.col("d") == 1) | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_words(words: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs ``a``, ``b`` of ``word`` that differ by one code point, each once, and the tables that hold them."""
    size = F.char_length("word").cast("int")
    as_ = lambda d: words.select(
        "word", (size - d).alias("size"), F.lit(d).alias("d"), F.lit(0).alias("start"), (size - d).alias("length")
    )
    open_rows = halves(halves(as_(0).unionByName(as_(1).where("size > 0"))))
    found, scratch = None, []
    while True:
        rows = keys(open_rows)
        counts = rows.groupBy("key", "length").agg(F.count("*").alias("c"))
        crowded = saved(counts.where((F.col("c") > crowd) & (F.col("length") > 1)).select("key"), "crowded")
        scratch.append(crowded)
        done = crowded.isEmpty()
        pairs = verified(rows if done else rows.join(crowded, "key", "left_anti"))
        found = pairs if found is None else found.unionByName(pairs)
        if done:
            break
        open_rows = saved(halves(rows.join(crowded, "key", "left_semi").drop("key")), "crowds")
        scratch.append(open_rows)
    out = saved(found.distinct(), "near")
    discard(*scratch)
    return out, [out]


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form: forms followed to the last, by doubling the steps."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(
            now.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots"
        )
        discard(now)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")
        now.saved_in = step.saved_in


def group_variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """A row per row of ``words`` (``word``, ``n``): word, form, root, n, n_near, form_n. Words that occur often and never are
    misspelt stay their own root."""
    pairs, scratch = near_words(words, crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = named.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    rows = words.join(best, words["word"] == best["a"], "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"),
        F.when(is_form, -F.col("best.m")).alias("form_n")
    )
    rows = saved(rows, "forms")
    discard(*scratch)
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents: word, form, root, n, n_near, form_n."""
    words = saved(vocabulary(read_table(spark, sf_dir, "documents")), "words")
    return group_variants(words)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

#: Checksums by their table (made from the polynomial); near words are those that share what is left without one code
#: point at one place (as long), or one of which is what is left of the other.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS step FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h
  FROM counted, tab
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % {SPOILT} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), less AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
cut AS (SELECT word, n, p, left(word, p) || substring(word, p + 2) AS rest FROM less),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (SELECT a, count(*) AS n_near, arg_min(b, (-m, b)) AS b, max(m) AS m FROM pairs GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN b END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
  FROM words LEFT JOIN best ON word = a
), steps AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
), last AS (SELECT s.word, s.root FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""
ORACLES = {"op11_spelling_variants": ORACLE}
