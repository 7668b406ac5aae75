"""Quality metrics over sets of rankings, answers and latencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import questions as q
from quillon.functions import text as t
from quillon.operators import containment
from quillon.operators.versions import kept


def judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """runs (query_id, doc_id, rank) with rel (null: not relevant); qrels: query_id, doc_id, rel, each pair once."""
    return runs.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left")


def at_k(runs: DataFrame, qrels: DataFrame, queries: DataFrame, cutoffs: list[int] | None = None, total: DataFrame | None = None) -> DataFrame:
    """query_id, k, precision, recall, hit, ndcg, rr of every query and cut-off.

    Queries without results count with zeros; precision divides by k; the ideal
    ranking is of the query's own judgements.  total: query_id, relevant (counts); with
    it qrels may leave out pairs that are neither in runs nor among the best of a query.
    """
    cut = F.explode(F.array(*map(F.lit, cutoffs or K.CUTOFFS))).alias("k")
    gain = lambda rel, rank: F.coalesce(rel, F.lit(0.0)) / F.log2(rank + 1.0)
    hit = F.when(F.col("rel") > 0, 1).otherwise(0)
    found = judged(runs, qrels).select("*", cut).filter("rank <= k").groupBy("query_id", "k").agg(F.sum(hit).alias("hits"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    first = judged(runs, qrels).filter("rel > 0").groupBy("query_id").agg(F.min("rank").alias("first"))
    w = W.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ranked = qrels.filter("rel > 0").withColumn("r", F.row_number().over(w))
    if total is None:
        total = ranked.groupBy("query_id").agg(F.count("*").alias("relevant"))
    ideal = ranked.select("*", cut).filter("r <= k").groupBy("query_id", "k").agg(F.sum(gain(F.col("rel"), F.col("r"))).alias("idcg"))
    rows = queries.select("query_id").distinct().select("query_id", cut).join(found, ["query_id", "k"], "left").join(ideal, ["query_id", "k"], "left").join(total, "query_id", "left").join(first, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id", "k", zero(F.col("hits") / F.col("k")).alias("precision"), zero(F.col("hits") / F.col("relevant")).alias("recall"),
        F.coalesce((F.col("hits") > 0).cast("double"), F.lit(0.0)).alias("hit"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1.0 / F.col("first")).alias("rr"),
    )


def aggregated(per_query: DataFrame, *by: str) -> DataFrame:
    """Means over the queries for each k (and by)."""
    return per_query.groupBy(*by, "k").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "hit", "ndcg")], F.round(F.avg("rr"), 4).alias("mrr"))


# ---------------------------------------------------------------- answers


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?](?U)\s+"), t.strip), lambda s: F.length(s) > 20)


def bigrams(c: Column) -> Column:
    words = F.array_remove(F.split(F.lower(c), r"(?U)\s+"), "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.transform(F.array(words), pairs)[0])


def faithfulness(answer: Column, context: Column, least: float = 0.3) -> Column:
    """Share of the sentences of which a share least of the bigrams is in the context; 1 without sentences."""
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  computed once, used often
    anchored = lambda b, ctx: (F.size(b) > 0) & (F.size(F.array_intersect(b, ctx)) / F.greatest(F.size(b), F.lit(1)) >= least)
    share = lambda s, ctx: F.size(F.filter(F.transform(s, bigrams), lambda b: anchored(b, ctx))) / F.size(s)
    return once(sentences(answer), lambda s: F.when(F.size(s) == 0, 1.0).otherwise(once(bigrams(context), lambda ctx: share(s, ctx))))


def hallucination(faith: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - faith)


def cited_sources(answer: Column) -> Column:
    """Lower-cased source names of the citations, up to the first comma."""
    return F.transform(F.regexp_extract_all(answer, F.lit(f"(?i){K.CITATION}"), F.lit(1)), lambda x: F.lower(t.strip(F.split_part(x, F.lit(","), F.lit(1)))))


def citation_count(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(f"(?i){K.CITATION}"))


def citation_precision(answer: Column, names: Column) -> Column:
    """Share of the citations whose source and some known name contain one another; 0 without citations."""
    cited = cited_sources(answer)
    known = F.filter(F.transform(names, F.lower), lambda n: n != "")
    ok = F.filter(cited, lambda c: F.exists(known, lambda n: c.contains(n) | n.contains(c)))
    return F.when(F.size(cited) == 0, 0.0).otherwise(F.size(ok) / F.greatest(F.size(cited), F.lit(1)))


def citation_precision_among(answers: DataFrame, sources: DataFrame, key: list[str], text: str = "answer", name: str = "name") -> DataFrame:
    """key, n_cited, n_verified, precision of every answer against any number of source names: citation_precision() without an array of all of them."""
    cited = answers.select(*key, F.monotonically_increasing_id().alias("_row"), cited_sources(F.col(text)).alias("cited"))
    each = cited.select("_row", F.explode("cited").alias("name"))
    # an empty citation stands in every name, as in citation_precision()
    some = sources.filter(F.col(name) != "").limit(1).select(F.lit("").alias("name"))
    known = containment.related(each, sources, other=name).union(some)
    n = each.join(known, "name").groupBy("_row").agg(F.count("*").alias("n"))
    out = cited.join(n, "_row", "left").select(*key, F.coalesce(F.size("cited"), F.lit(0)).alias("n_cited"), F.coalesce("n", F.lit(0)).cast("int").alias("n_verified"))
    return out.withColumn("precision", F.when(F.col("n_cited") <= 0, 0.0).otherwise(F.col("n_verified") / F.greatest("n_cited", F.lit(1))))


def generation_summary(rows: DataFrame, *by: str) -> DataFrame:
    """rows: lang, is_refusal, citation_precision, faithfulness.  Refusals count in their rate alone."""
    ok = lambda c, more=F.lit(True): F.avg(F.when(~F.col("is_refusal") & more, F.col(c)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("is_refusal").cast("double")).alias("refusal_rate"), F.coalesce(ok("citation_precision"), F.lit(0.0)).alias("citation_precision"), F.coalesce(ok("faithfulness"), F.lit(0.0)).alias("faithfulness"),
        F.coalesce(ok("faithfulness", F.col("lang") == "fr"), F.lit(0.0)).alias("fr"), F.coalesce(ok("faithfulness", F.col("lang") == "en"), F.lit(0.0)).alias("en"),
    )
    isb = F.when((F.col("fr") > 0) & (F.col("en") > 0), q.parity(F.col("fr"), F.col("en"))).otherwise(0.0)
    return out.withColumn("hallucination_rate", hallucination(F.col("faithfulness"))).withColumn("isb", isb).withColumn("meets", (F.col("citation_precision") >= K.PRECISION) & (F.col("hallucination_rate") <= K.HALLUCINATION) & (F.col("isb") >= K.PARITY))


def constraints(run: DataFrame) -> DataFrame:
    """Adds constraints_met, a struct of booleans, to runs (citation_precision, hallucination_rate, isb, p50_ms, p95_ms)."""
    met = {"citation_precision_ok": F.col("citation_precision") >= K.PRECISION, "hallucination_ok": F.col("hallucination_rate") <= K.HALLUCINATION, "isb_ok": F.col("isb") >= K.PARITY, "p50_ok": F.col("p50_ms") <= K.P50_MS, "p95_ok": F.col("p95_ms") <= K.P95_MS}
    return run.withColumn("constraints_met", F.struct(*[c.alias(n) for n, c in met.items()]))


def latency_split(rows: DataFrame, value: str, retrieval: float = 0.6) -> DataFrame:
    """Adds retrieval_ms and generation_ms: a fixed split of one latency, synthetic, not measured."""
    return rows.withColumn("retrieval_ms", F.col(value) * retrieval).withColumn("generation_ms", F.col(value) * (1 - retrieval))


def parity_gap(rows: DataFrame, lang: str, metric: str, value: str) -> DataFrame:
    """metric, fr, en, isb, gap: means by language, side by side."""
    p = rows.groupBy(metric).pivot(lang, ["fr", "en"]).agg(F.avg(value))
    p = p.select(metric, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fr", "en")])
    return p.withColumn("isb", q.parity(F.col("fr"), F.col("en"))).withColumn("gap", F.abs(F.col("fr") - F.col("en")))


# ---------------------------------------------------------------- latencies


def percentiles(rows: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, n, p (an array): exact percentiles of each group by linear interpolation on n - 1, without a group in one task.

    Distinct values and their counts are dealt out by range of (group, value), so a group
    is a run of partitions.  Prefix sums over these (one row for a partition and group)
    tell in which of them a percentile lies; only such partitions are searched, each by
    itself.  Nulls and NaN do not count; groups without a value have n 0 and nulls.
    """
    v = F.col(value).cast("double")
    counts = rows.select(*by, v.alias("_v")).filter("_v is not null and not isnan(_v)").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    at = kept(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    group = W.partitionBy(*by)
    parts = at.groupBy("_part", *by).agg(F.sum("_n").alias("_in"))
    parts = parts.withColumn("_before", F.sum("_in").over(group.orderBy("_part")) - F.col("_in")).withColumn("n", F.sum("_in").over(group))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)])
    asked = parts.withColumn("_r", F.explode(ranks)).withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_r.at"), F.ceil("_r.at")))))
    asked = asked.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_in")))
    asked = asked.groupBy("_part", *by).agg(F.first("_before").alias("_before"), F.first("n").alias("n"), F.collect_list(F.struct("_r.i", "_r.at", "_k")).alias("_asked"))
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    same = F.col("_part") == F.col("_at")
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    held = at.join(asked.withColumnsRenamed({**names, "_part": "_at"}), same)
    upto = F.sum("_n").over(W.partitionBy("_part", *by).orderBy("_v")) + F.col("_before")
    held = held.withColumn("_upto", upto).withColumn("_a", F.explode(F.filter("_asked", lambda a: (a["_k"] < F.col("_upto")) & (a["_k"] >= F.col("_upto") - F.col("_n")))))
    share = F.col("_a.at") - F.floor("_a.at")
    part = F.col("_v") * F.when(F.col("_a._k") == F.floor("_a.at"), 1 - share).otherwise(share)
    found = held.groupBy(*by, F.col("_a.i").alias("_i")).agg(F.max("n").alias("n"), F.sum(part).alias("_p"))
    out = found.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"]).alias("p"))
    if not by:
        return out.filter("n is not null").union(out.filter("n is null").select(F.lit(0).cast("long"), F.lit(None).cast("array<double>")))
    every = rows.select(*by).distinct()
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return every.join(out.withColumnsRenamed(names), same, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "p")


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Percentiles by linear interpolation on n - 1, mean, extremes, count."""
    p = percentiles(rows, value, list(by), [0.5, 0.75, 0.95, 0.99])
    rest = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    names = {c: f"_own{i}" for i, c in enumerate(by)}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    out = rest.join(p.drop("n").withColumnsRenamed(names), same, "left")
    return out.select(*by, *[F.col("p")[i].alias(name) for i, name in enumerate(("p50", "p75", "p95", "p99"))], "mean", "least", "most", "n")


def meets_slo(p50: Column, p95: Column, errors: Column) -> Column:
    return (p50 <= K.P50_MS) & (p95 <= K.P95_MS) & (errors <= K.ERRORS)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, exact.

    Bounds first, which cost the texts' length: characters that one text has more often
    than the other must go or come, and the way along the table's two ends is as short as
    it is.  Where these meet they are the distance.  Else they say how many characters a
    shorter way can put in and leave out: if it has but few diagonals, these alone are
    followed.

    Otherwise diagonals: with one edit more a round, how far each diagonal of the table
    reaches, which costs the texts' length and the square of the distance.  Once that
    has cost as much as bit vectors would over the whole table, these go on instead.
    """
    p, t = _unlike(*(np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)))
    n, m = len(p), len(t)
    if not n or not m:
        return n + m
    gone, come = _surplus(p, t)
    least, most = max(gone, come), _along_the_ends(p, t)
    if least == most:
        return most
    # a way with fewer than most edits puts in most - 1 - gone at most, as gone of the others are substituted or left out
    low, high = come + 1 - most, most - 1 - gone
    width = high - low + 1
    if most * width <= 4 * max(n, m) and n * width <= 1 << 22:
        return _by_band(p, t, low, high, most)
    found = _by_diagonals(p, t, n * m // 4000)
    return _by_bits(p, t) if found is None else found


def _unlike(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the start and the end that they share."""
    for step in (1, -1):
        size = min(len(p), len(t))
        x, y = (p[:size], t[:size]) if step == 1 else (p[len(p) - size :][::-1], t[len(t) - size :][::-1])
        other = x != y
        same = int(other.argmax()) if other.any() else size
        p, t = (p[same:], t[same:]) if step == 1 else (p[: len(p) - same], t[: len(t) - same])
    return p, t


def _surplus(p: np.ndarray, t: np.ndarray) -> tuple[int, int]:
    """How many of p's characters are more than t has of them, and the other way round."""
    size = int(max(p.max(), t.max())) + 1
    if size > 1 << 16:
        code = np.unique(np.concatenate((p, t)), return_inverse=True)[1]
        p, t, size = code[: len(p)], code[len(p) :], int(code.max()) + 1
    more = np.bincount(p, minlength=size) - np.bincount(t, minlength=size)
    return int(more[more > 0].sum()), int(-more[more < 0].sum())


def _along_the_ends(p: np.ndarray, t: np.ndarray) -> int:
    """Edits of the best way that keeps to the diagonal of the starts up to one place, and to that of the ends from there on."""
    size = min(len(p), len(t))
    start = np.cumsum(p[:size] != t[:size])
    end = np.cumsum(p[len(p) - size :] != t[len(t) - size :])
    return abs(len(p) - len(t)) + int(end[-1]) + min(0, int((start - end).min()))


def _by_band(p: np.ndarray, t: np.ndarray, low: int, high: int, most: int) -> int:
    """The distance, or most, if no way of fewer edits keeps to the diagonals from low to high."""
    n, m = len(p), len(t)
    ends = [min(n, m - k) for k in range(low, high + 1)]
    stops = []  # of each diagonal, the places in p where it is not equal, and its end
    for k, end in zip(range(low, high + 1), ends, strict=True):
        first = max(0, -k)
        other = np.flatnonzero(p[first:end] != t[first + k : end + k]) + first if end > first else np.zeros(0, np.int64)
        stops.append([*other.tolist(), end])
    width, at = len(ends), [0] * len(ends)
    none = -2 - most  # not reached, however many edits more
    reach = [none] * (width + 2)
    reach[1 - low] = stops[-low][0]
    goal = m - n - low + 1
    for e in range(most):
        if reach[goal] >= n:
            return e
        new = [none] * (width + 2)
        for d in range(width):
            i = max(reach[d + 1] + 1, reach[d + 2] + 1, reach[d])  # substituted, p's left out, t's put in
            if i < 0:
                continue
            if i < ends[d]:
                stop, x = stops[d], at[d]
                while stop[x] < i:
                    x += 1
                at[d] = x
                i = stop[x]
            else:
                i = ends[d]
            new[d + 1] = i
        reach = new
    return most


def _by_diagonals(p: np.ndarray, t: np.ndarray, most: int) -> int | None:
    """The distance; None if the rounds have looked at most diagonals before it was found."""
    n, m = len(p), len(t)
    # reach[k]: how many of p's characters diagonal k - e (place in t less place in p) covers with e edits
    reach = np.array([_slide(p, t, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]])
    e = looked = 0
    while not (abs(m - n) <= e and reach[m - n + e] >= n):
        e += 1
        looked += 2 * e + 1
        if looked > max(most, 4096):
            return None
        k = np.arange(-e, e + 1)
        wide = np.full(2 * e + 3, -2, np.int64)
        wide[2:-2] = reach
        i = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])  # substituted, p's left out, t's put in
        i = np.minimum(np.minimum(i, n), m - k)
        ok = (i >= 0) & (i + k >= 0)
        reach = np.where(ok, i, -2)
        reach[ok] = _slide(p, t, i[ok], i[ok] + k[ok])
    return e


def _slide(p: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far p from i and t from j are equal, as the place in p: all pairs at once, by steps that grow where they succeed."""
    i, j = i.copy(), j.copy()
    live = np.flatnonzero((i < len(p)) & (j < len(t)))
    while len(live) > 4:
        live = live[p[i[live]] == t[j[live]]]
        i[live] += 1
        j[live] += 1
        live = live[(i[live] < len(p)) & (j[live] < len(t))]
    for k in live:
        step = 64
        while True:
            x, y = p[i[k] : i[k] + step], t[j[k] : j[k] + step]
            size = min(len(x), len(y))
            other = np.flatnonzero(x[:size] != y[:size])
            same = int(other[0]) if len(other) else size
            i[k] += same
            j[k] += same
            if same < step:
                break
            step = min(2 * step, 1 << 20)
    return i


def _by_bits(p: np.ndarray, t: np.ndarray) -> int:
    """A column of the table is two bit vectors (Myers), one long integer each."""
    where = {int(c): int.from_bytes(np.packbits(p == c, bitorder="little").tobytes(), "little") for c in np.intersect1d(p, t)}
    full = (1 << len(p)) - 1
    up, down = full, 0  # where the column rises by one from row to row, and where it falls
    for c in t.tolist():
        eq = where.get(c, 0)
        same = ((((eq & up) + up) ^ up) | eq | down) & full
        right = (((down | (full ^ (same | up))) << 1) | 1) & full
        left = ((same & up) << 1) & full
        up, down = left | (full ^ (same | right)), right & same
    return len(t) + up.bit_count() - down.bit_count()


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    # one pair of texts at a time
    return pa.array([edit_distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(a, b, strict=True)], pa.int64())


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of the whole texts over the reference's length; an empty reference: 0 if the other is empty too, else 1; null if either is."""
    n = F.length(reference)
    distance = F.arrow_udf(_distances, "long")(reference, hypothesis)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.greatest(n, F.lit(1)))
