"""Mixing sources to target weights by repetition rates.

Sizes are summed per source, weights become targets under an epoch cap, and a
document is taken floor(rate) times plus once more with probability equal to
the fraction, decided by a hash of the row (its id, text and source, and which of
equal rows it is), so reruns agree and rows never share a decision.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from archlens.llm.prefix import running
from archlens.llm.registry import query, table
from archlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
HEX_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by ``key`` (null counts as an empty string) and ``seed``."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** HEX_DIGITS))


def row_key(doc_id: Column, text: Column, source: Column) -> Column:
    """One digest of a row's id, text and source; a null counts as empty."""
    def said(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(said(doc_id), F.lit("|"), said(F.md5(text.cast("binary"))), F.lit("|"), said(source)).cast("binary"))


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: which of the rows with its ``key`` a row is, from 0, in no order.

    Only rows whose key repeats are shuffled whole. They are counted per key and
    input partition, one row each, so a key's rows are never together.
    """
    again = rows.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    marked = rows.withColumn("__pid", F.spark_partition_id()).join(again, F.col(key) == F.col("__again"), "left")
    alone = marked.where("__again IS NULL").withColumn(out, F.lit(0).cast("long")).drop("__again", "__pid")
    many = cut_lineage(marked.where("__again IS NOT NULL").drop("__again"))
    ahead = Window.partitionBy("__of").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    first = many.groupBy(F.col(key).alias("__of"), F.col("__pid").alias("__in")).agg(F.count(F.lit(1)).alias("__n"))
    first = first.select("__of", "__in", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(key, "__pid").orderBy(F.lit(0))
    placed = (many.withColumn(out, F.row_number().over(inside).cast("long") - 1)
              .join(first, (F.col(key) == F.col("__of")) & (F.col("__pid") == F.col("__in")))
              .withColumn(out, F.col(out) + F.col("__first")))
    return alone.unionByName(placed.select(*alone.columns))


def source_targets(docs: DataFrame, source: str, size: str, weights: list[int],
                   max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target): one row per source.

    Sources in code-point order, null last, take ``weights`` in turn. A target
    is the source's share of all sizes, at most ``max_epochs`` times its size;
    what a capped source leaves is reshared by weight among the others until
    no target is above its cap. Sources without words get target 0.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = running(sums.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"})
    turn = F.array(*[F.lit(int(w)) for w in weights])
    found = cut_lineage(ranked.select(
        "source", "source_size",
        F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap")))
    total = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = 0.0
    while True:  # each pass caps at least one more source; three numbers come back
        over = (F.col("cap") <= F.col("weight") * F.lit(level)) | (F.col("cap") == 0)
        seen = found.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open")).first()
        if not seen["open"]:
            break
        raised = (total - seen["capped"]) / seen["open"]
        if raised <= level:
            break
        level = raised
    return found.select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def source_rates(docs: DataFrame, *, source: str = "source", size: str = "size", weights: list[int],
                 max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target, rate): how often the mix takes each document of a source, on average."""
    cap = F.lit(float(max_epochs))
    return source_targets(docs, source, size, weights, max_epochs).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), cap)).otherwise(0.0)
        .alias("rate"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: list[int], max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` plus the struct ``mix``: source_size, target (its source's) and copies (times it is taken).

    Hot sources cost nothing: sizes are summed before the shuffle, and the
    per-source rates (one row a source) are joined back, broadcast by Spark's
    own size check only. A null source is a source of its own; rows without
    words are taken as often as their source's rate says, with 0 words; a
    source without words is not taken. Rows that repeat an id, or have none, decide
    each for itself, equal rows too. A column already named ``mix`` is replaced; columns
    whose names begin with ``__`` are reserved.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rates = source_rates(sized, weights=weights, max_epochs=max_epochs)
    keyed = docs.withColumn("__key", row_key(F.col(doc_id), F.col(text), F.col(source)))
    return with_copies(keyed, rates, key="__key", source=source, seed=seed).drop("__key")


def with_copies(docs: DataFrame, rates: DataFrame, *, key: str, source: str = "source", seed: int = 7) -> DataFrame:
    """``docs`` plus the struct ``mix`` from given ``source_rates``; ``key`` is a column of ``row_key``."""
    docs = numbered(docs, key, "__time")
    rated = docs.join(rates.select(F.struct("*").alias("__rate")),
                      docs[source].eqNullSafe(F.col("__rate.source")), "left")
    whole = F.floor("__rate.rate")
    draw = uniform(F.concat(F.col(key), F.lit(":"), F.col("__time").cast("string")), seed)
    once_more = draw < F.col("__rate.rate") - whole
    return rated.withColumn("mix", F.struct(
        F.col("__rate.source_size").alias("source_size"), F.col("__rate.target").alias("target"),
        (whole + once_more.cast("long")).cast("long").alias("copies"))).drop("__rate", "__time")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per taken copy: the columns before ``mix``, and ``copy`` from 0."""
    taken = mixed.where("mix.copies > 0")
    return (taken.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("mix.copies") - 1).cast("int"))))
            .drop("mix"))


ORACLE = f"""
WITH docs AS (
  SELECT *, row_number() OVER (PARTITION BY key) - 1 AS time FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '') || '|' || coalesce(source, '')) AS key
    FROM documents)),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap
  FROM sums),
placed AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM ranked),
levels AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS before_cap, coalesce(sum(weight) OVER w, 0) AS before_weight
  FROM placed WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT ((total - before_cap)::BIGINT / (weights - before_weight)::BIGINT)::DOUBLE AS level
  FROM levels WHERE cap / weight > (total - before_cap)::BIGINT / (weights - before_weight)::BIGINT
  ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * coalesce((SELECT level FROM chosen), 'infinity'::DOUBLE)) AS target
  FROM ranked),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(rate) + CASE WHEN
     ('0x' || substr(md5(d.key || ':' || d.time || ':7'), 1, {HEX_DIGITS}))::BIGINT::DOUBLE
       / {16 ** HEX_DIGITS}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""


@query("op1_mix_sources", ORACLE)
def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, sources weighing 1, 2, 3 in turn, at most 3 epochs."""
    sized = cut_lineage(table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("key")))
    mixed = with_copies(sized, source_rates(sized, weights=[1, 2, 3], max_epochs=3), key="key")
    return mixed.select("doc_id", "size", "mix.source_size", "mix.target",
                        (F.col("size") * F.col("mix.copies")).alias("taken"))
