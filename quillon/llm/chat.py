"""Chat formatting: cumulative snapshots collapse, then conversations are rendered.

Logs often hold a conversation once more after every turn.  A rolling hash of
each conversation's first i turns (running sums of two 64-bit hashes of place,
role and text) is compared with the hashes of whole conversations: one that is a
proper prefix of a longer one goes by an anti-join, and of equal ones the
smallest id stays.  Both sides are pre-aggregated, so a conversation logged by a
third of all rows is one row before it meets the others.  DataFrame functions
only.

Turns are ordered by turn, ties by their hash.  Null role or text: empty.  Null
conv_id: one conversation.  Repeated rows: repeated turns.  Very long
conversations: one row of the result, as it is defined.  No rows: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the maximal conversations."""
    t = _hashed(turns).select("conv_id", "turn", "unit")
    w = W.partitionBy("conv_id").orderBy("turn", "unit")
    t = t.withColumn("i", F.row_number().over(w).cast("long"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    for name, seed in (("p", 1), ("q", 2)):
        t = t.withColumn(name, F.sum(F.xxhash64(F.lit(seed), "i", "unit").cast("decimal(28,0)")).over(upto))
    t = t.withColumn("n_turns", F.count("*").over(W.partitionBy("conv_id")))
    full = t.filter("i = n_turns").groupBy("n_turns", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = t.filter("i < n_turns").select(F.col("i").alias("n_turns"), "p", "q").distinct()
    return full.join(prefixes, ["n_turns", "p", "q"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds rendered to kept: '<|role|>\\ntext<|end|>\\n' of every turn in order."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    of = _hashed(turns).select(F.col("conv_id").alias("c"), "turn", "unit", line.alias("line"))
    lines = of.join(kept, F.col("c").eqNullSafe(F.col("conv_id"))).groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("turn", "unit", "line"))).alias("lines"))
    return lines.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, collapse(turns))


def _hashed(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", "role", "text", F.md5(F.concat(role, F.lit("\n"), text).cast("binary")).alias("unit"))


SQL = """
WITH t AS (SELECT conv_id, turn, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS unit,
             '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM conversations),
s AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(unit, '' ORDER BY turn, unit) AS units, string_agg(line, '' ORDER BY turn, unit) AS rendered FROM t GROUP BY conv_id),
r AS (SELECT min(conv_id) AS conv_id, n_turns, units, count(*)::BIGINT AS n_copies, min(rendered) AS rendered FROM s GROUP BY n_turns, units)
SELECT conv_id, n_turns, n_copies, rendered FROM r
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n_turns > r.n_turns AND starts_with(s.units, r.units))
"""
