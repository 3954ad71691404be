"""Line-first quality cleaning, in DataFrame functions only.

Lines with a word are judged one by one: three words or more and no end of a sentence,
mostly symbols, navigation separators, shouted exclamation marks, or boilerplate phrases in
a short line.  Failing lines are removed; a document that loses more than
``MOST_LOST`` percent of its characters, or fails the base rules, is rejected.

Everything is a projection over a row: no shuffle, no Python, no grouping.
The words are split once; 5-word windows are compared by 64-bit hashes, and
the sort that finds repeated windows is done only for texts that have any.

Defined cases: null counts as a text without words (rejected by the base
rules); a text without lines loses nothing; repeated rows get equal results;
a text may be of any length; ``judge`` ignores other columns and ``clean_lines``
hands them on; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import SPACE

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
MOST_LOST = 30
#: The symbols that are counted, ends of sentences, and phrases of boilerplate lines.
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?:;…][\"'»”’)\]]*([\x20\x09-\x0D]|$)"
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "sign up", "sign in", "log in", "subscribe", "newsletter",
    "javascript", "lorem ipsum", "click here", "read more", "share this", "back to top", "skip to content", "follow us",
)
SHORT_LINE = 12


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def failing_line(line: Column) -> Column:
    """Whether a line that has a word fails one of the rules."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    unended = ~line.rlike(SENTENCE_END) & (n_words >= 3)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 10 > n_words
    navigation = F.regexp_count(line, F.lit(r"[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]")) * 5 > n_words
    shouting = F.regexp_count(line, F.lit("!!")) * 5 > n_words
    boilerplate = (n_words <= SHORT_LINE) & F.lower(line).rlike("|".join(BOILERPLATE))
    return unended | symbols | navigation | shouting | boilerplate


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; hashes: of the windows, by their first word."""
    first_of = lambda array, f: F.get(F.transform(F.array(array), f), F.lit(0))  # noqa: E731  evaluates array once

    def starts(pairs: Column) -> Column:
        alike = lambda x, k: F.coalesce(x["h"] == F.get(pairs, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, k + 1)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, alike), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, v: a + v)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return first_of(first_of(pairs, starts), covered)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept, n_lines, n_lines_removed, share_removed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), words(text).alias("_words"))
    rows = rows.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + j) for j in range(WINDOW)])
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        F.col(id_col),
        F.col("_text"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        windows.alias("_windows"),
        lines.alias("_lines"),
    )
    failed = F.filter("_lines", failing_line)
    rows = rows.select(
        id_col,
        "n_words",
        "word_chars",
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeated(F.col("_windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.array_join("_lines", "")).cast("long").alias("_chars"),
        failed.alias("_failed"),
    )
    rows = rows.withColumn("_lost", F.length(F.array_join("_failed", "")).cast("long")).withColumn("n_lines_removed", F.size("_failed").cast("long"))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (100 * F.col("_lost") <= MOST_LOST * F.col("_chars"))).alias("kept"),
        "n_lines", "n_lines_removed",
    )


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the failing lines of each text removed; lines without a word stay."""
    wordless = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x: wordless(x) | ~failing_line(x))
    return docs.withColumn(text_col, F.array_join(kept, "\n"))


_SQL_FAILS = r"""(
  (NOT regexp_matches(x, '[.!?:;…]["''»”’)\]]*([\x20\x09-\x0D]|$)') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 3)
  OR len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
  OR len(regexp_extract_all(x, '[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]')) * 5 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
  OR len(regexp_extract_all(x, '!!')) * 5 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
  OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 12 AND regexp_matches(lower(x), '@BOILERPLATE@'))
)""".replace("@BOILERPLATE@", "|".join(BOILERPLATE))

ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), u AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d
), s AS (
  SELECT r, p, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
  FROM u WINDOW o AS (PARTITION BY r ORDER BY p)
), v AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) AS c FROM s WHERE x4 IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT p + k) AS n FROM v, generate_series(0, 4) AS g(k) WHERE c >= 2 GROUP BY r
), a AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(array_to_string(lines, '')) AS chars,
         list_filter(lines, lambda x: @FAILS@) AS failed
  FROM d LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * length(array_to_string(failed, '')) <= 30 * chars AS kept,
       n_lines, len(failed) AS n_lines_removed
FROM a
""".replace("@FAILS@", _SQL_FAILS)
