"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. With the
documents in a fixed order (size class, then a seeded hash of id and text), the prefix sums of the expected copies
are rate * rank; one offset a source is added and a document is taken once for each integer that its
interval crosses, so floor(rate) or ceil(rate) times. Sorting by size class spreads the copies evenly
over short and long documents, which keeps the taken words near the target.

The rank is found without gathering a source in one task: rows are counted in buckets (source, size
class, two hex digits of the hash), bucket counts are summed up over at most 30 000 buckets a source,
and only the rank within a bucket needs the bucket's rows together.

Cases: null text has size 0; null source is a source of its own, last in order; a source without words
has target 0; an empty table gives an empty result; rows repeated in full share their bucket, are each
sampled and can't be told apart; rows that agree in id and text are ordered by their other columns (but
for maps, which have no order). So reruns agree, whatever order the rows come in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): shares of `share` times all words by weight, none above `most` times its source.

    What a full source can't take goes to the others by weight. Taking sources by most * size / weight, a
    source is full if the level that the rest would have reaches its own; the others end at the common level.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", weight.alias("weight")).withColumn("most", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    room = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", room / F.sum("weight").over(on)).withColumn("full", F.col("level") >= F.col("most") / F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return by.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(common * F.col("weight")).alias("target"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """docs with mix__size, mix__source_size, mix__target and mix__copies, how often the mix takes each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    other = [c for c in docs.columns if c not in ("doc_id", "text") and "map<" not in docs.schema[c].dataType.simpleString()]
    rows = docs.withColumn("mix__size", size)
    kind = "cast(length(bin(mix__size)) * 8 + (shiftright(mix__size, greatest(length(bin(mix__size)) - 4, 0)) & 7) as int)"
    rows = rows.withColumns({"mix__source": F.col("source"), "mix__class": F.expr(kind), "mix__hash": order, "mix__part": F.substring(order, 1, 2), "mix__none": F.col("text").isNull(), "mix__other": F.xxhash64(*other) if other else F.lit(0)})
    bucket = ["mix__source", "mix__class", "mix__part"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("mix__source").orderBy("mix__class", "mix__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(c).alias(f"{c}_") for c in bucket), F.coalesce(first, F.lit(0)).alias("mix__first"))
    targets = source_targets(rows.select(F.col("source"), F.col("mix__size").alias("size")), weights, share, most)
    targets = targets.withColumnsRenamed({"source": "mix__of", "source_size": "mix__source_size", "target": "mix__target"})
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|offset|"), F.coalesce("mix__source", F.lit("\0")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ranked = rows.withColumn("mix__rank", F.row_number().over(Window.partitionBy(*bucket).orderBy("mix__hash", "doc_id", "mix__none", "mix__other")))
    ranked = ranked.join(counts, F.expr(" and ".join(f"{c} <=> {c}_" for c in bucket))).join(targets, F.expr("mix__source <=> mix__of"))
    rate = F.when(F.col("mix__source_size") > 0, F.col("mix__target") / F.col("mix__source_size")).otherwise(F.lit(0.0))
    place = (F.col("mix__first") + F.col("mix__rank")).cast("double")
    ranked = ranked.withColumns({"mix__rate": rate, "mix__u": u, "mix__place": place})
    copies = F.expr("floor(mix__rate * mix__place + mix__u) - floor(mix__rate * (mix__place - 1) + mix__u)").cast("long")
    return ranked.select(*docs.columns, "mix__size", "mix__source_size", "mix__target", copies.alias("mix__copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    taken = with_copies(docs, **options).where("mix__copies > 0")
    return taken.withColumn("mix__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix__copies")))).select(*docs.columns)


def op8_mixing(docs: DataFrame) -> DataFrame:
    rows = with_copies(docs.select("doc_id", "source", "text"))
    taken = (F.col("mix__copies") * F.col("mix__size")).alias("taken")
    return rows.select("doc_id", F.col("mix__size").alias("size"), F.col("mix__source_size").alias("source_size"), F.col("mix__target").alias("target"), taken, "source", F.col("mix__copies").alias("copies"))


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, text IS NULL AS none, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || digest) AS hash FROM rows),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level >= most / weight THEN most ELSE max(CASE WHEN level < most / weight THEN level END) OVER () * weight END AS target FROM levels),
ranked AS (
  SELECT k.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY k.source ORDER BY class, hash, doc_id, none)::DOUBLE AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|offset|' || coalesce(k.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM (
  SELECT *, (floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT AS copies FROM ranked)
"""
