"""Registered queries: answers and their quality, latencies, limits, audit, stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import questions as q
from quillon.functions import text as t
from quillon.operators import answers, metrics, store
from quillon.plans.inputs import ANSWERS, phrase, phrase_sql, quote, table
from quillon.plans.retrieval import query
from quillon.streaming import limits

CITE = r"\[(?:Source|Src|Ref)\s*:\s*([^\]]+?)\]"
NAMES = "['src1', 'SRC12', 'other', '']"
ANSWERED = f"a AS (SELECT conv_id, turn, {phrase_sql('conv_id * 3 + turn', ANSWERS)} || ' ' || text AS answer FROM conversations WHERE role = 'assistant')"
CITED = f"c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '(?i){CITE}', 1), lambda x: lower(trim(string_split(x, ',')[1]))) AS cited FROM a)"


def _answered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat(phrase(F.col("conv_id") * 3 + F.col("turn"), ANSWERS), F.lit(" "), F.col("text")).alias("answer"))


@query(f"WITH {ANSWERED}, {CITED} SELECT conv_id, turn, array_to_string(cited, '|') AS cited FROM c")
def citations(spark, sf_dir):
    return _answered(spark, sf_dir).select("conv_id", "turn", F.array_join(metrics.cited_sources(F.col("answer")), "|").alias("cited"))


@query(f"WITH {ANSWERED} SELECT conv_id, turn, len(regexp_extract_all(answer, '(?i){CITE}'))::BIGINT AS n FROM a")
def citation_count(spark, sf_dir):
    return _answered(spark, sf_dir).select("conv_id", "turn", metrics.citation_count(F.col("answer")).cast("long").alias("n"))


VERIFIED = f"list_filter(cited, lambda x: len(list_filter({NAMES}, lambda n: n <> '' AND (contains(x, lower(n)) OR contains(lower(n), x)))) > 0)"


@query(f"WITH {ANSWERED}, {CITED} SELECT conv_id, turn, CASE WHEN len(cited) = 0 THEN 0.0 ELSE round(len({VERIFIED}) / len(cited), 6) END AS precision FROM c")
def citation_precision(spark, sf_dir):
    names = F.array(*map(F.lit, ["src1", "SRC12", "other", ""]))
    return _answered(spark, sf_dir).select("conv_id", "turn", F.round(metrics.citation_precision(F.col("answer"), names), 6).alias("precision"))


@query(r"""WITH a AS (SELECT conv_id, turn, lower(trim(regexp_extract(text, '^[^,\[\]]*?([^ ,\[\]]+ [^ ,\[\]]+)', 1))) AS c FROM conversations WHERE role = 'assistant'),
n AS (SELECT DISTINCT c FROM a WHERE c <> ''), s AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:8], ' ')) AS s FROM documents WHERE text <> ''),
k AS (SELECT c FROM n WHERE EXISTS (SELECT 1 FROM s WHERE s <> '' AND (contains(s, c) OR contains(c, s))))
SELECT conv_id, turn, (c <> '')::INT AS n_cited, (k.c IS NOT NULL)::INT AS n_verified, (k.c IS NOT NULL)::INT::DOUBLE AS precision FROM a LEFT JOIN k USING (c)""")
def citation_sources(spark, sf_dir):
    """Every answer cites its first two words; which of them stand in the head of some document, or the other way round."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    cited = F.regexp_extract("text", r"^[^,\[\]]*?([^ ,\[\]]+ [^ ,\[\]]+)", 1)
    a = a.select("conv_id", "turn", F.when(cited != "", F.concat(F.lit("[Source: "), cited, F.lit(", p. 1]"))).otherwise("").alias("answer"))
    heads = table(spark, sf_dir, "documents").select(F.substring_index("text", " ", 8).alias("name"))
    return metrics.citation_precision_among(a, heads, ["conv_id", "turn"])


SENT = r"list_filter(list_transform(regexp_split_to_array(answer, '[.!?]\s+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: length(s) > 20)"


def _bigrams_sql(c):
    w = rf"list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> '')"
    return f"list_distinct(list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1]))"


# Each answer against the user's turn before it and the first half of the answer itself.
PAIRS = """p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text || ' ' || substring(a.text, 1, length(a.text) // 2) AS context FROM conversations a
  JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"""
FAITH = f"""{PAIRS}, b AS (SELECT conv_id, turn, {SENT} AS sents, {_bigrams_sql('context')} AS ctx FROM p),
e AS (SELECT conv_id, turn, ctx, unnest(sents) AS s FROM b), g AS (SELECT conv_id, turn, ctx, {_bigrams_sql('s')} AS big FROM e),
n AS (SELECT conv_id, turn, count(*) AS n, sum((len(big) > 0 AND len(list_intersect(big, ctx)) / greatest(len(big), 1) >= 0.3)::INT) AS ok FROM g GROUP BY ALL),
f AS (SELECT p.conv_id, p.turn, CASE WHEN n IS NULL THEN 1.0 ELSE ok / n END AS faith FROM p LEFT JOIN n USING (conv_id, turn))"""


def _faith(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    a = c.filter("role = 'assistant'").join(u, ["conv_id", "turn"])
    context = F.concat("asked", F.lit(" "), F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    return a.select("conv_id", "turn", metrics.faithfulness(F.col("text"), context).alias("faith"))


@query(f"WITH {FAITH} SELECT conv_id, turn, round(faith, 6) AS faithfulness FROM f")
def faithfulness(spark, sf_dir):
    return _faith(spark, sf_dir).select("conv_id", "turn", F.round("faith", 6).alias("faithfulness"))


@query(f"WITH {FAITH} SELECT conv_id, turn, round(greatest(0.0, 1.0 - faith), 6) AS hallucination FROM f")
def hallucination(spark, sf_dir):
    return _faith(spark, sf_dir).select("conv_id", "turn", F.round(metrics.hallucination(F.col("faith")), 6).alias("hallucination"))


@query(f"""WITH {FAITH}, r AS (SELECT *, conv_id % 7 = 0 AS is_refusal, CASE WHEN conv_id % 2 = 0 THEN 'fr' ELSE 'en' END AS lang, (conv_id % 10) / 10.0 AS cp FROM f),
m AS (SELECT count(*) AS n, avg(is_refusal::INT) AS refusal_rate, avg(cp) FILTER (NOT is_refusal) AS cp, avg(faith) FILTER (NOT is_refusal) AS fa, avg(faith) FILTER (NOT is_refusal AND lang = 'fr') AS fr, avg(faith) FILTER (NOT is_refusal AND lang = 'en') AS en FROM r)
SELECT n, round(refusal_rate, 6) AS refusal_rate, round(cp, 6) AS citation_precision, round(fa, 6) AS faithfulness, round(greatest(0.0, 1 - fa), 6) AS hallucination_rate, round(CASE WHEN fr > 0 AND en > 0 THEN least(fr, en) / greatest(fr, en) ELSE 0.0 END, 6) AS isb,
cp >= 0.95 AND 1 - fa <= 0.05 AND CASE WHEN fr > 0 AND en > 0 THEN least(fr, en) / greatest(fr, en) ELSE 0.0 END >= 0.85 AS meets FROM m""")
def generation_summary(spark, sf_dir):
    rows = _faith(spark, sf_dir).select((F.col("conv_id") % 7 == 0).alias("is_refusal"), F.when(F.col("conv_id") % 2 == 0, "fr").otherwise("en").alias("lang"), (F.col("conv_id") % 10 / 10.0).alias("citation_precision"), F.col("faith").alias("faithfulness"))
    s = metrics.generation_summary(rows)
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("refusal_rate", "citation_precision", "faithfulness", "hallucination_rate", "isb")], "meets")


ISB = "CASE WHEN fr <= 0 AND en <= 0 THEN 1.0 WHEN fr <= 0 OR en <= 0 THEN 0.0 ELSE least(fr, en) / greatest(fr, en) END"
GAPS = "g AS (SELECT source AS metric, coalesce(avg(quality) FILTER (lang = 'fr'), 0) AS fr, coalesce(avg(quality) FILTER (lang = 'en'), 0) AS en FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


def _quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("metric")).join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH m AS (SELECT coalesce(avg(quality) FILTER (lang = 'fr'), 0) AS fr, coalesce(avg(quality) FILTER (lang = 'en'), 0) AS en FROM documents JOIN labels USING (doc_id)) SELECT round({ISB}, 6) AS isb, {ISB} >= 0.85 AS acceptable FROM m")
def isb(spark, sf_dir):
    m = _quality(spark, sf_dir).agg(*[F.coalesce(F.avg(F.when(F.col("lang") == x, F.col("quality"))), F.lit(0.0)).alias(x) for x in ("fr", "en")])
    v = q.parity(F.col("fr"), F.col("en"))
    return m.select(F.round(v, 6).alias("isb"), (v >= 0.85).alias("acceptable"))


@query(f"WITH {GAPS} SELECT metric, round(fr, 6) AS fr, round(en, 6) AS en, round({ISB}, 6) AS isb, round(abs(fr - en), 6) AS gap FROM g")
def parity_gap(spark, sf_dir):
    p = metrics.parity_gap(_quality(spark, sf_dir), "lang", "metric", "quality")
    return p.select("metric", *[F.round(c, 6).alias(c) for c in ("fr", "en", "isb", "gap")])


PCT = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))


@query(f"SELECT event_type, {PCT}, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    s = metrics.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p75", "p95", "p99", "mean")], "least", "most", "n")


@query("""SELECT event_type, round(quantile_cont(value * 100, 0.5), 6) AS p50, round(quantile_cont(value * 100, 0.95), 6) AS p95, round(avg((event_id % 150 = 0)::INT), 6) AS errors,
quantile_cont(value * 100, 0.5) <= 5000 AND quantile_cont(value * 100, 0.95) <= 15000 AND avg((event_id % 150 = 0)::INT) <= 0.01 AS meets, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS rps FROM events GROUP BY 1""")
def slo_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    s = e.groupBy("event_type").agg(F.percentile(F.col("value") * 100, F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.avg((F.col("event_id") % 150 == 0).cast("int")).alias("e"), (F.count("*") / F.greatest(F.max("at") - F.min("at"), F.lit(1.0))).alias("r"))
    return s.select("event_type", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), F.round("e", 6).alias("errors"), metrics.meets_slo(F.col("p")[0], F.col("p")[1], F.col("e")).alias("meets"), F.round("r", 9).alias("rps"))


# Levenshtein distances are of bytes there, so each non-ASCII character becomes one control character first.
_ONE_BYTE = "m AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS marks FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE unicode(c) > 127)"
_CODES = " || ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 32), 127))


@query(f"""WITH {_ONE_BYTE}, r AS (SELECT doc_id, length(text) AS n, translate(text, marks, {_CODES}) AS r, replace(substring(translate(text, marks, {_CODES}), 3), 'e', 'c') AS h FROM documents, m)
SELECT doc_id, round(CASE WHEN n = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, h) / n END, 6) AS cer FROM r""")
def cer(spark, sf_dir):
    """Whole texts of all documents, against themselves without two characters and with c for e."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(metrics.character_error_rate(F.col("text"), F.replace(F.substr("text", F.lit(3)), F.lit("e"), F.lit("c"))), 6).alias("cer"))


@query(f"""WITH h AS (SELECT doc_id // 5 AS query_id, doc_id % 5 + 1 AS rank, CASE WHEN (doc_id // 5) % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS page, CASE WHEN doc_id % 4 = 0 THEN 'loi' ELSE '' END AS doc_type, (doc_id % 1000) / 1000.0 AS score, text AS content FROM documents)
SELECT query_id, md5(CASE WHEN any_value(lang) = 'en' THEN {quote(answers.HEADS['en'][0])} ELSE {quote(answers.HEADS['fr'][0])} END || chr(10) || string_agg(chr(10) || '[DOCUMENT ' || rank || '] Source: ' || source || CASE WHEN coalesce(page, 0) <> 0 THEN ', ' || CASE WHEN lang = 'en' THEN 'page' ELSE 'p.' END || ' ' || page ELSE '' END || CASE WHEN doc_type <> '' THEN ' [' || doc_type || ']' ELSE '' END || chr(10) || 'Score: ' || printf('%.3f', score::DOUBLE) || chr(10) || content, chr(10) ORDER BY rank)) AS context FROM h GROUP BY 1""")
def prompt_context(spark, sf_dir):
    i = F.col("doc_id")
    h = table(spark, sf_dir, "documents").select(
        F.floor(i / 5).alias("query_id"), (i % 5 + 1).alias("rank"), F.when(F.floor(i / 5) % 2 == 0, "en").otherwise("fr").alias("lang"), "source", F.when(i % 3 != 0, i % 7).alias("page"),
        F.when(i % 4 == 0, "loi").otherwise("").alias("doc_type"), (i % 1000 / 1000.0).alias("final_score"), F.col("text").alias("content"),
    )
    return answers.context_prompt(h).withColumn("context", F.md5("context"))


@query(r"""WITH w AS (SELECT conv_id, turn, role, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text, lead(role) OVER x AS nr, lead(text) OVER x AS nt FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, text AS q, nt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM w WHERE role = 'user' AND nr = 'assistant')
SELECT conv_id, string_agg('Tour ' || n || ' :' || chr(10) || 'Q: ' || q || chr(10) || 'R: ' || substring(trim(nt, chr(32) || chr(9) || chr(10) || chr(13)), 1, 300) || CASE WHEN length(nt) > 300 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY n) AS context FROM p WHERE n > c - 5 GROUP BY 1""")
def session_context(spark, sf_dir):
    return answers.session_context(table(spark, sf_dir, "conversations"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT key, n, event_id, us, [us] AS times, '' AS reason FROM e WHERE n = 1
  UNION ALL SELECT key, n, event_id, us, CASE WHEN reason = '' THEN list_append(held, us) ELSE held END, reason
  FROM (SELECT *, CASE WHEN len(list_filter(held, lambda x: x >= us - 60000000)) >= 1 THEN 'minute' WHEN len(held) >= 2 THEN 'hour' ELSE '' END AS reason
    FROM (SELECT e.key, e.n, e.event_id, e.us, list_filter(s.times, lambda x: x >= e.us - 3600000000) AS held FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)))
SELECT key, event_id, us / 1e6 AS at, reason = '' AS allowed, reason FROM s""")
def rate_limit(spark, sf_dir):
    """Small limits, so that some requests are refused."""
    return limits.limit_batch(limits.requests(table(spark, sf_dir, "events")), 1, 2)


@query("SELECT user_id AS key, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_count(spark, sf_dir):
    return limits.sliding_count(limits.requests(table(spark, sf_dir, "events")), 86400).select("key", "event_id", "n")


AUDIT = "SELECT event_type, md5(user_id::VARCHAR)[1:12] AS session_id, user_id::VARCHAR AS user_id, '{\"event_id\":' || event_id || ',\"value\":\"' || printf('%.3f', value) || '\"}' AS payload_json, event_id % 9 = 0 AS is_flagged FROM events"


@query(AUDIT)
def audit_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.format_string("%.3f", "value").alias("value"), F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 12).alias("session_id"), F.col("user_id").cast("string").alias("user_id"))
    flags = F.when(F.col("event_id") % 9 == 0, F.array(F.lit("prompt_injection_attempt"))).otherwise(F.array().cast("array<string>"))
    return answers.audit(e, F.col("event_type"), ["event_id", "value"], flags)


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS n_flagged FROM events GROUP BY ALL")
def audit_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 9 == 0).alias("n_flagged"))


@query("SELECT d.doc_id, d.source, count(l.doc_id) AS n_children, max(l.quality)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def doc_chunk_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    c = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n_children"), F.max("quality").cast("long").alias("quality"))
    return d.join(c, "doc_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 11 <> 0")
def cascade_delete(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    left = store.cascade({"documents": d, "labels": l}, d.filter("doc_id % 11 = 0"))
    return left["documents"].agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n").union(left["labels"].agg(F.count("*").alias("n")).select(F.lit("labels").alias("name"), "n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE quality END::BIGINT AS quality FROM labels UNION ALL SELECT -1, 9")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    new = old.filter("doc_id % 3 = 0").select("doc_id", F.lit(9).cast("long").alias("quality"))
    new = new.union(new).union(spark.createDataFrame([(-1, 9)], new.schema))
    return store.upsert(old, new, "doc_id")


@query("SELECT count(DISTINCT string_split(url, '/')[3]) AS n_folders, count(*) AS n_files, sum(strlen(html))::BIGINT AS n_bytes FROM pages")
def storage_stats(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("folder"), F.octet_length("html").cast("long").alias("n"))
    return store.stats(p, "folder", "n")


@query("SELECT CASE WHEN bool_and(n > 0) THEN 'ok' ELSE 'degraded' END AS status, count(*) AS n_checks FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM embeddings)")
def health(spark, sf_dir):
    check = lambda name: table(spark, sf_dir, name).agg(F.when(F.count("*") > 0, "ok").otherwise("error").alias("status")).select(F.lit(name).alias("name"), "status")
    return store.health(check("documents").union(check("embeddings")))


@query("SELECT page_id, length(html) < 400 AS needs_ocr FROM pages")
def scanned_pages(spark, sf_dir):
    from quillon.sources import files

    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x"), F.regexp_replace("html", r"(?U)\s", "x")).alias("text"))
    return files.scanned(p, 401).select("page_id", "needs_ocr")


@query(rf"""SELECT conv_id, turn, CASE WHEN n <= 60 THEN text ELSE regexp_replace(substring(text, 1, 57), '\s+$', '') || '...' END AS short, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM (SELECT *, length(text) AS n FROM conversations)""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.truncate(F.col("text"), 60).alias("short"), t.escape_html(F.col("text")).alias("escaped"))


@query("SELECT reason, lang, CASE WHEN reason IN ('security_violation', 'out_of_scope', 'insufficient') THEN 1 ELSE 0 END AS n_flags, count(*) AS n FROM (SELECT (['security_violation', 'out_of_scope', 'insufficient', 'strange'])[(doc_id % 4 + 1)::INT] AS reason, lang FROM documents) GROUP BY ALL")
def refusals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(phrase(F.col("doc_id"), ["security_violation", "out_of_scope", "insufficient", "strange"]).alias("reason"), "lang")
    r = d.withColumn("r", answers.refusal(F.col("reason"), F.col("lang"))).filter("r.answer is not null")
    return r.groupBy("reason", "lang", F.size("r.flags").alias("n_flags")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id // 2 AS trace_id, epoch_us(ts) AS a FROM events WHERE event_id % 2 = 0), e AS (SELECT event_id // 2 AS trace_id, min(epoch_us(ts)) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT s.trace_id, a / 1e6 AS started, (b - a) / 1000.0 AS latency_ms, b IS NULL AS timed_out FROM s LEFT JOIN e ON s.trace_id = e.trace_id AND b BETWEEN a AND a + 3600000000""")
def request_latency(spark, sf_dir):
    """Events of even and odd number as starts and ends of requests, an hour apart at most."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("trace_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = limits.request_latency(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), timeout="1 hour")
    return found.select("trace_id", (F.unix_micros("started") / 1e6).alias("started"), "latency_ms", "timed_out")
