"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

A line fails as mark-up noise, as navigation or as boilerplate. Failing lines
are removed; a document that loses more than half of its words goes.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from archlens.llm import words as W
from archlens.llm.batches import bounded
from archlens.llm.registry import query, table

SHORT_LINE = 30          # words; longer lines are prose, whatever phrases they hold
FRAGMENT = 6             # words; shorter lines must end as sentences do
MARKED_SHARE = 0.3       # of a line's words that carry mark-up or shouting
LINK_SHARE = 0.2         # of a line's words that are bare separators
LOST_SHARE = 0.5         # of a document's words

MARKED_TEXT = r"[#*$%&|<>]|!!|\?\?"
SEPARATOR_TEXT = "^(?:[|>/-]|»|›|·|•|&gt;|&raquo;)+$"
SENTENCE_END_TEXT = "(?:[.!?:;,\"')\\]]|…|”|’|»)$"
BOILERPLATE_TEXT = (
    r"(?i)\b(?:cookies?|javascript|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|"
    r"click here|sign (?:up|in)|log ?in|subscribe|newsletter|share (?:this|on)|powered by|skip to content|"
    r"read more|follow us)\b")
NAVIGATION_TEXT = (r"(?i)^(?:home|about(?: us)?|contact(?: us)?|menu|search|next|previous|back|top|faq|help|sitemap|rss)"
                   r"[.:]?$")
MARKED, SEPARATOR, SENTENCE_END, BOILERPLATE, NAVIGATION = (
    re.compile(t.encode()) for t in (MARKED_TEXT, SEPARATOR_TEXT, SENTENCE_END_TEXT, BOILERPLATE_TEXT, NAVIGATION_TEXT))
SIGN = re.compile(MARKED_TEXT.encode() + "|[/-]|»|›|·|•".encode())  # a line without one has neither kind of word

RESULT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_left_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_())])
COLUMNS = [f.name for f in RESULT]
# a type object, as workers import this module without a session to parse a string
SPARK_RESULT = T.StructType([T.StructField(f.name, T.BooleanType() if f.type == pa.bool_() else T.LongType())
                             for f in RESULT])


def line_fails(words: list[bytes], line: bytes) -> bool:
    """Whether a line with words is noise rather than text."""
    n = len(words)
    marked = separators = 0
    if SIGN.search(line):
        marked = sum(1 for w in words if MARKED.search(w))
        separators = sum(1 for w in words if SEPARATOR.match(w))
    if marked > MARKED_SHARE * n or separators >= 3 and separators >= LINK_SHARE * n:
        return True
    if n <= SHORT_LINE and BOILERPLATE.search(line):
        return True
    stripped = line.strip(W.BLANKS)
    return n < FRAGMENT and (not SENTENCE_END.search(stripped) or bool(NAVIGATION.match(stripped)))


def examine(text: bytes | None) -> tuple[list, bytes | None]:
    """Counts and verdict of one text, and the text without its failing lines."""
    if text is None:
        return [0, 0, 0, 0, 0, 0, True, False], None
    lines = text.split(b"\n")
    words = text.split()
    n = len(words)
    repeats = W.repeated_window_words(words)
    left, stay, seen = 0, [], set()
    for line in lines:
        own = line.split()
        if own:
            if line in seen or line_fails(own, line):
                continue
            seen.add(line)
            left += len(own)
        stay.append(line)
    base_failed = n < 50 or 100 * repeats > 50 * n
    kept = not base_failed and n - left <= LOST_SHARE * n
    return [n, W.code_points(text) - W.count_of(text, W.BLANKS), W.count_of(text, W.SYMBOLS),
            W.repeated_lines(lines), repeats, left, base_failed, kept], b"\n".join(stay)


def _verdicts(texts: pa.Array, with_text: bool) -> pa.Array:
    rows, cleaned = [], []
    for text in W.utf8(texts):
        row, rest = examine(text)
        rows.append(row)
        if with_text:
            cleaned.append(rest)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(RESULT), RESULT)]
    names = list(COLUMNS)
    if with_text:
        columns.append(pa.array(cleaned, pa.binary()).cast(pa.string()))
        names.append("clean_text")
    return pa.StructArray.from_arrays(columns, names)


@F.arrow_udf(SPARK_RESULT)
def _counts(texts: pa.Array) -> pa.Array:
    return _verdicts(texts, with_text=False)


@F.arrow_udf(T.StructType([*SPARK_RESULT, T.StructField("clean_text", T.StringType())]))
def _cleaned(texts: pa.Array) -> pa.Array:
    return _verdicts(texts, with_text=True)


def apply_rules(docs: DataFrame, *, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` plus a struct column ``rules``: the counts, base_failed, kept, and clean_text if asked.

    One pass without a shuffle; a text is read whole, one at a time. A null or
    empty text has no words and fails the base rules (clean_text stays null or
    empty). Of lines that repeat, the first stays. A column already named
    ``rules`` is replaced.
    """
    run = (_cleaned if with_text else _counts).asNondeterministic()  # else each use of a field runs it again
    return bounded(docs).withColumn("rules", run(F.col(text)))


def keep_clean(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with failing lines removed from their text, columns as given."""
    columns = docs.columns
    found = apply_rules(docs.select(F.struct("*").alias("doc"), F.col(text).alias("text")), with_text=True)
    return found.where("rules.kept").select(
        *[F.col("rules.clean_text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in columns])


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
lw AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM (
  SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS own, trim(line, {BLANK_SQL}) AS bare FROM l) WHERE len(own) > 0),
lc AS (SELECT *, len(own) AS n, len([x FOR x IN own IF regexp_matches(x, {_sql(MARKED_TEXT)})]) AS marked,
  len([x FOR x IN own IF regexp_matches(x, {_sql(SEPARATOR_TEXT)})]) AS separators FROM lw),
lv AS (SELECT r, n, nth, marked > {MARKED_SHARE}::DOUBLE * n OR (separators >= 3 AND separators >= {LINK_SHARE}::DOUBLE * n)
  OR (n <= {SHORT_LINE} AND regexp_matches(line, {_sql(BOILERPLATE_TEXT)}))
  OR (n < {FRAGMENT} AND (NOT regexp_matches(bare, {_sql(SENTENCE_END_TEXT)}) OR regexp_matches(bare, {_sql(NAVIGATION_TEXT)}))) AS fails
  FROM lc),
la AS (SELECT r, count(*) FILTER (nth > 1) AS dups, sum(n) FILTER (nth = 1 AND NOT fails) AS stay FROM lv GROUP BY r),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM (
  SELECT r, i, list_slice(words, i, i + 2) AS tri FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range(3) q(k) WHERE c > 1 GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stay, 0)::BIGINT AS n_left_words
  FROM w LEFT JOIN la USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_left_words <= {LOST_SHARE}::DOUBLE * n_words AS kept FROM b
"""


@query("op8_line_rules", ORACLE)
def op8_line_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and the line-first verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in COLUMNS])
