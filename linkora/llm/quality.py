"""Operator 2: quality rules with cross-document line frequency, with DataFrame functions only.

Base rules look at one text. The method counts, for each host (column `source`) and normalised line, the distinct documents with
that line; a line is removed if it is in more than `least` documents of the host and in more than `per_mille` of 1000 of them; a
document that loses more than `depleted` percent of its words is rejected.

Normalised: lower case, white space within the line collapsed, trimmed; lines without a word are ignored. Lines and word windows are
compared by 64-bit hash. Edge cases: null and empty texts have no words and fail the base rules. Rows that are equal in doc_id,
source and text are one document for the counts, and each is returned. A null source is a host of its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SALT = 16


def _bind(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


WORDS = "filter(split(t, '[\\\\x20\\\\x09-\\\\x0D]+', -1), x -> x <> '')"
# Positions of windows of 3 words whose hash comes twice or more; then the words they cover, windows may overlap.
REPEATED = _bind(
    "if(size(w) < 3, array(), transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2])))",
    "h",
    "if(size(array_distinct(h)) = size(h), 0, "
    + _bind(
        "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))",
        "s",
        _bind(
            "sort_array(transform(filter(s, (x, j) -> (j > 0 and x.h = s[greatest(j - 1, 0)].h) or (j < size(s) - 1 and x.h = s[least(j + 1, size(s) - 1)].h)), x -> x.i))",
            "q",
            "aggregate(transform(q, (x, j) -> if(j = size(q) - 1, 3, least(3, q[least(j + 1, size(q) - 1)] - x))), 0, (a, x) -> a + x)",
        ),
    )
    + ")",
)
LINES = "filter(transform(split(regexp_replace(lower(t), '[\\\\x20\\\\x09\\\\x0B-\\\\x0D]+', ' '), '\\n', -1), x -> trim(x)), x -> x <> '')"


def _key(host: str, line: Column) -> Column:
    return F.xxhash64(F.col(host), line)


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("t")).withColumn("rk", F.xxhash64("doc_id", "host", "t"))


def common_lines(base: DataFrame, least: int, per_mille: int) -> DataFrame:
    """base (rk, host, t) -> (key): hashes of host and normalised line that are in too many documents of the host."""
    one = base.select("rk", "host", F.explode(F.array_distinct(F.expr(LINES))).alias("line")).select("rk", "host", _key("host", F.col("line")).alias("key"))
    hosts = base.select("rk", "host").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    # Only lines above the first limit, by rows, can be above it by documents: those few are counted exactly, salted by document.
    freq = one.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > least)
    spread = F.pmod("rk", F.lit(SALT)).cast("int")
    copies = freq.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    exact = one.withColumn("salt", spread).join(copies, ["key", "salt"]).select("key", "rk", "host").distinct().groupBy("key").agg(F.count("*").alias("docs_with"), F.first("host").alias("host"))
    return exact.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where((F.col("docs_with") > least) & (1000 * F.col("docs_with") > per_mille * F.col("docs"))).select("key")


def _spots(base: DataFrame, limit: DataFrame) -> DataFrame:
    """(rk, no, words): the lines of each document, by their place among all lines of the text, that are too common."""
    raw = base.select("rk", "host", F.posexplode(F.split("t", "\n", -1)).alias("no", "raw"))
    lines = raw.select("rk", "host", "no", F.trim(F.regexp_replace(F.lower("raw"), r"[\x20\x09\x0B-\x0D]+", " ")).alias("line")).where("line <> ''")
    spread = F.pmod("rk", F.lit(SALT)).cast("int")
    above = limit.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    spots = lines.select("rk", "no", F.size(F.split("line", " ")).alias("words"), _key("host", F.col("line")).alias("key")).withColumn("salt", spread)
    return spots.join(above, ["key", "salt"]).select("rk", "no", "words").distinct()


def filtered(docs: DataFrame, least: int = 10, per_mille: int = 5, depleted: int = 50) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the rows that the rules keep, with their text without the lines that are too common.

    Columns are those of docs. Rows without a word fail the base rules and go.
    """
    base = _base(docs)
    spots = _spots(base, common_lines(base, least, per_mille))
    gone = spots.groupBy("rk").agg(F.collect_set("no").alias("gone"))
    rk = free_name(docs, "row")
    verdict = quality(docs, least, per_mille, depleted, keep_row=True).where("kept").select(F.col("rk").alias(rk)).distinct()
    keyed = docs.withColumn(rk, F.xxhash64(F.col("doc_id").cast("long"), F.col("source"), F.coalesce("text", F.lit(""))))
    out = keyed.join(verdict, rk, "left_semi").join(gone.select(F.col("rk").alias(rk), F.col("gone").alias(cut := free_name(docs, "cut"))), rk, "left")
    parts = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(F.coalesce(~F.array_contains(cut, i), F.lit(True)), line))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.array_compact(parts), "\n"))
    return out.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality(docs: DataFrame, least: int = 10, per_mille: int = 5, depleted: int = 50, keep_row: bool = False) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept.

    `filtered` gives the kept documents with their cleaned texts.
    """
    base = _base(docs)
    removed = _spots(base, common_lines(base, least, per_mille)).groupBy("rk").agg(F.sum("words").cast("long").alias("n_removed_words"))

    words = base.select("doc_id", "rk", "t", F.expr(WORDS).alias("w"))
    dup = "filter(split(t, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    stats = words.select(
        "doc_id",
        "rk",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr(_bind(dup, "l", "size(l) - size(array_distinct(l))")).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).cast("long").alias("n_repeat_words"),
    )
    out = stats.join(removed, "rk", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_removed_words") <= depleted * F.col("n_words")))
    return out.select(*(["rk"] if keep_row else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def op2_quality_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
u AS (SELECT min(rid) AS rid, source, t FROM d GROUP BY doc_id, source, t),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS gram FROM (SELECT rid, ws, unnest(range(len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
l AS (SELECT d.rid, source, doc_id, t, unnest(list_transform(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))) AS line FROM d),
lines AS (SELECT * FROM l WHERE line <> ''),
h AS (SELECT source, count(*) AS docs FROM u GROUP BY source),
f AS (SELECT lines.source, line, count(DISTINCT lines.rid) AS n FROM lines JOIN u USING (rid) GROUP BY ALL),
lim AS (SELECT f.source, line FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n > 10 AND 1000 * n > 5 * docs),
gone AS (SELECT rid, sum(len(string_split(lines.line, ' '))) AS n FROM lines JOIN lim ON lines.line = lim.line AND lines.source IS NOT DISTINCT FROM lim.source GROUP BY rid),
s AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept FROM s
"""
