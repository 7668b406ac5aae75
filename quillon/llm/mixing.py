"""Mixing sources to target weights.

Every document gets a hash-random key.  Keys are uniform, so the leading hex
digits of a key range-sort each source into cells of like size, however large
one source is; cell sums are prefix-summed per source, and a document's place
in its source is its cell's prefix plus its prefix within the cell.  Each
source's epoch order is cut exactly at its budget; budgets over the source's
size repeat epochs.

Null source: a source of its own, last.  Null or empty text: size 0, takes
nothing.  Repeated doc_ids: ordered by size; each row counts.  No rows: no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", digits: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words taken, repeats counted), epochs (whole passes of the source).

    weights repeat over the sources by code point, null last; together sources get
    share of all words, none over cap times its own, the excess reshared by weight.
    digits: hex digits of the key that make a cell (16**digits cells a source).
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    base = checkpoint(base.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("key", key).withColumn("cell", F.substring("key", 1, digits)))
    cells = base.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(W.partitionBy("skey").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sized = targets(base.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, share, cap)
    cells = cells.join(sized, "skey").select("skey", "cell", "before", "source_size", "target")
    inside = W.partitionBy("skey", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = base.join(cells, ["skey", "cell"]).withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    return (
        placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.greatest(budget - F.col("epochs") * F.col("source_size") - F.col("place"), F.lit(0)), F.col("size")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "epochs")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds target to one row per source (skey, source_size): water filling.

    Sources fill up in the order of their cap over their weight; with the first k
    full, the rest share what is left by weight.  The first k for which no other
    source would overflow is the answer.  One row per source is sorted in one task.
    """
    rank = F.row_number().over(W.orderBy(F.col("skey") == "", "skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumn("limit_", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("limit_") / F.col("weight"))
    upto = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("full_before", F.coalesce(F.sum("limit_").over(upto), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    t = t.withColumn("w_all", F.sum("weight").over(everything)).withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(everything))
    t = t.withColumn("level", (F.col("pool") - F.col("full_before")) / (F.col("w_all") - F.col("w_before")))
    # the level at which this source and all after it stay under their caps; sources before the first such one are full
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(everything)["level"])
    return t.select("skey", "source_size", F.when(F.col("final").isNull() | (F.col("final") > F.col("ratio")), F.col("limit_")).otherwise(F.col("final") * F.col("weight")).alias("target"))


SQL = """
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
s1 AS (SELECT *, ([3.0::DOUBLE, 1.0, 2.0])[((row_number() OVER (ORDER BY skey = '', skey) - 1) % 3 + 1)] AS weight, 2.0::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, lim / weight AS ratio FROM s1),
s3 AS (SELECT *, coalesce(sum(lim) OVER u, 0.0::DOUBLE) AS full_before, coalesce(sum(weight) OVER u, 0.0::DOUBLE) AS w_before,
         sum(weight) OVER () AS w_all, 1.5::DOUBLE * sum(source_size) OVER () AS pool
       FROM s2 WINDOW u AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (pool - full_before) / (w_all - w_before) AS level FROM s3),
s5 AS (SELECT *, (SELECT x.level FROM s4 x WHERE x.level <= x.ratio ORDER BY x.ratio, x.skey LIMIT 1) AS final FROM s4),
s6 AS (SELECT skey, source_size, CASE WHEN final IS NULL OR final > ratio THEN lim ELSE final * weight END AS target FROM s5),
p AS (SELECT b.*, s.source_size, s.target, floor(s.target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY b.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM base b JOIN s6 s USING (skey)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - place, 0), size))::BIGINT AS taken
FROM q
"""
