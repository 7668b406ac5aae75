"""Registered queries: text functions, metadata, chunks, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import constants as K
from quillon.functions import questions as q
from quillon.functions import text as t
from quillon.operators import chunking, store
from quillon.plans.inputs import LAWS, QUESTIONS, asked, laws, quote, table, terms_sql, word_sql
from quillon.plans.retrieval import query

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CLEAN = r"regexp_replace(text, '[^\P{C}\n\t]', '', 'g')"
for _a, _b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
    CLEAN = f"replace({CLEAN}, '{_a}', '{_b}')"
CLEAN = rf"regexp_replace(regexp_replace({CLEAN}, '-\n([\pL\pN_])', '\1', 'g'), '(?m)^\s*[0-9]+\s*$', '', 'g')"
CLEAN = rf"array_to_string(list_filter(string_split({CLEAN}, chr(10)), lambda x: NOT regexp_matches({STRIP.format('x')}, '^-?\s*[0-9]+\s*-?$')), chr(10))"
CLEAN = rf"replace(translate({CLEAN}, '«»“”–—', '" + '""""--' + "'), '…', '...')"
CLEAN = rf"CASE WHEN lang = 'fr' THEN regexp_replace({CLEAN}, '(^|[^\pL\pN_])Art\.\s+', '\1Article ', 'g') ELSE {CLEAN} END"
CLEAN = STRIP.format(rf"regexp_replace(regexp_replace({CLEAN}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, md5(c) AS cleaned, length(c)::BIGINT AS n_chars FROM (SELECT doc_id, {CLEAN} AS c FROM documents)")
def clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.clean(F.col("text"), F.col("lang")).alias("c"))
    return d.select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n_chars"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(rf"SELECT doc_id, length({STRIP.format('text')}) >= 50 AND NOT regexp_matches({STRIP.format('text')}, '^[^\pL_]+$') AS sufficient FROM documents")
def content_sufficient(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.sufficient(F.col("text")).alias("sufficient"))


def _first_sql(c, patterns):
    return "CASE " + " ".join(f"WHEN {word_sql(c, p)} THEN '{name}'" for name, p in patterns) + " END"


@query(f"WITH {LAWS} SELECT doc_id, {_first_sql('substring(text, 1, 500)', K.DOC_TYPES)} AS doc_type FROM l")
def doc_type(spark, sf_dir):
    return laws(spark, sf_dir).select("doc_id", t.doc_type(F.col("text")).alias("doc_type"))


@query(f"WITH {LAWS} SELECT doc_id, {_first_sql('substring(text, 1, 1000)', K.INSTITUTIONS)} AS institution FROM l")
def institution(spark, sf_dir):
    return laws(spark, sf_dir).select("doc_id", t.institution(F.col("text")).alias("institution"))


def _any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, {quote(w)})" for w in words) + ")"


@query(f"WITH {LAWS}, h AS (SELECT doc_id, lower(substring(text, 1, 2000)) AS s FROM l) SELECT doc_id, CASE WHEN {_any_sql('s', K.COMMON_LAW)} THEN 'common_law' WHEN contains(s, 'ohada') THEN 'ohada' WHEN {_any_sql('s', K.CIVIL_LAW)} THEN 'civil_law' END AS jurisdiction FROM h")
def jurisdiction(spark, sf_dir):
    return laws(spark, sf_dir).select("doc_id", t.jurisdiction(F.col("text")).alias("jurisdiction"))


_NUM = r"(?:^|[^\pL\pN_])([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})(?:$|[^\pL\pN_])"
_MONTHS = " ".join(rf"WHEN regexp_matches(s, '(?i)(?:^|[^\pL\pN_])[0-9]{{1,2}}\s+{m}\s+[0-9]{{4}}(?:$|[^\pL\pN_])') THEN regexp_extract(s, '(?i)(?:^|[^\pL\pN_])[0-9]{{1,2}}\s+{m}\s+([0-9]{{4}})', 1) || '-{i:02d}-' || lpad(regexp_extract(s, '(?i)(?:^|[^\pL\pN_])([0-9]{{1,2}})\s+{m}\s+[0-9]{{4}}', 1), 2, '0')" for i, m in enumerate(K.MONTHS, 1))


@query(f"WITH {LAWS}, h AS (SELECT doc_id, text AS s FROM l) SELECT doc_id, CASE WHEN regexp_matches(s, '{_NUM}') THEN regexp_extract(s, '{_NUM}', 3) || '-' || lpad(regexp_extract(s, '{_NUM}', 2), 2, '0') || '-' || lpad(regexp_extract(s, '{_NUM}', 1), 2, '0') {_MONTHS} END AS date_document FROM h")
def extract_date(spark, sf_dir):
    return laws(spark, sf_dir).select("doc_id", t.document_date(F.col("text")).alias("date_document"))


@query(f"WITH {LAWS}, h AS (SELECT doc_id, {STRIP.format('text')} AS s FROM l) SELECT doc_id, coalesce(" + ", ".join(f"nullif(regexp_extract(s, '(?i){p}', 1), '')" for p in K.ARTICLE_PATTERNS) + rf") AS article, regexp_matches(s, '(?i)^{K.STRUCTURE}') AS separator FROM h")
def article_ref(spark, sf_dir):
    return laws(spark, sf_dir).select("doc_id", t.article_number(F.col("text")).alias("article"), t.is_separator(F.col("text")).alias("separator"))


_MOST, _OVERLAP = K.CHUNK_TOKENS * K.CHARS_A_TOKEN, K.OVERLAP_TOKENS * K.CHARS_A_TOKEN
_STOP = f"CASE WHEN {{0}} + {_MOST} >= length(text) THEN {{0}} + {_MOST} ELSE {{0}} + CASE WHEN length(regexp_extract(substring(text, {{0}} + {_OVERLAP + 1}, {_MOST - _OVERLAP}), '^(?s:.*)[ \n]')) >= 2 THEN {_OVERLAP - 1} + length(regexp_extract(substring(text, {{0}} + {_OVERLAP + 1}, {_MOST - _OVERLAP}), '^(?s:.*)[ \n]')) ELSE {_MOST} END END"
_FIXED = f"""WITH RECURSIVE {LAWS}, o AS (SELECT doc_id, text FROM l WHERE {STRIP.format('text')} <> ''),
w AS (SELECT doc_id, 0 AS start, {_STOP.format('0')} AS stop FROM o WHERE length(text) > {_MOST}
  UNION ALL SELECT doc_id, start, {_STOP.format('start')} AS stop FROM (SELECT w.doc_id, o.text, greatest(w.stop - {_OVERLAP}, w.start + 1) AS start FROM w JOIN o USING (doc_id) WHERE w.stop < length(o.text))),
p AS (SELECT doc_id, start, {STRIP.format('substring(text, start + 1, stop - start)')} AS content FROM w JOIN o USING (doc_id) UNION ALL SELECT doc_id, 0, text FROM o WHERE length(text) <= {_MOST}),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, content FROM p WHERE content <> '')
SELECT doc_id, chunk_index, sha256(doc_id || '||' || chunk_index || '|' || content) AS chunk_id, length(content)::BIGINT AS n_chars, 'fixed_size' AS strategy, NULL::VARCHAR AS article_ref, greatest(1, length(content) // {K.CHARS_A_TOKEN})::INT AS token_count FROM c"""


_HEAD = K.STRUCTURE.replace("\\d", "[0-9]")
_REF = r"CASE WHEN regexp_matches({0}, '(?i)^(Article|Section)\s+[0-9]') THEN CASE lower(regexp_extract({0}, '(?i)^(Article|Section)', 1)) WHEN 'article' THEN 'Article ' ELSE 'Section ' END || regexp_extract({0}, '(?i)^(Article|Section)\s+([0-9]+)', 2) END"
# o: doc_id, text; segments between headings, long ones cut by windows; h: the chunks.
SEGMENTS = f"""g AS (SELECT doc_id, text, CASE WHEN parts[1] = '' THEN parts[2:] ELSE parts END AS parts FROM (SELECT doc_id, text, string_split(regexp_replace(text, '(?im)^({_HEAD})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM o)),
u AS (SELECT doc_id, k, text, CASE WHEN length(text) // {K.CHARS_A_TOKEN} * {K.CHARS_A_TOKEN} <= {_MOST} THEN 'structural' ELSE 'hybrid' END AS strategy FROM (SELECT doc_id, k, {STRIP.format('parts[k]')} AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM g WHERE len(parts) > 1)) WHERE text <> ''
  UNION ALL SELECT doc_id, 0, text, 'fixed_size' FROM g WHERE len(parts) <= 1),
w AS (SELECT doc_id, k, 0 AS start, {_STOP.format('0')} AS stop FROM u WHERE length(text) > {_MOST} AND strategy <> 'structural'
  UNION ALL SELECT doc_id, k, start, {_STOP.format('start')} AS stop FROM (SELECT w.doc_id, w.k, u.text, greatest(w.stop - {_OVERLAP}, w.start + 1) AS start FROM w JOIN u USING (doc_id, k) WHERE w.stop < length(u.text))),
p AS (SELECT doc_id, k, start, {STRIP.format('substring(text, start + 1, stop - start)')} AS content, strategy, text FROM w JOIN u USING (doc_id, k) UNION ALL SELECT doc_id, k, 0, text, strategy, text FROM u WHERE length(text) <= {_MOST} OR strategy = 'structural'),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, start) - 1 AS chunk_index, content, strategy, CASE WHEN strategy = 'fixed_size' THEN {_REF.format('content')} ELSE {_REF.format('text')} END AS article_ref FROM p WHERE content <> '')"""
_HYBRID = f"""WITH RECURSIVE {LAWS}, o AS (SELECT doc_id, text FROM l WHERE {STRIP.format('text')} <> ''), {SEGMENTS}
SELECT doc_id, chunk_index, sha256(doc_id || '||' || chunk_index || '|' || content) AS chunk_id, length(content)::BIGINT AS n_chars, strategy, article_ref, greatest(1, length(content) // {K.CHARS_A_TOKEN})::INT AS token_count FROM h"""


def _chunk_query(strategy, sql=None):
    def run(spark, sf_dir):
        rows = chunking.chunks(laws(spark, sf_dir), strategy)
        return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.length("content").cast("long").alias("n_chars"), "strategy", "article_ref", "token_count")

    run.__name__ = f"chunk_{strategy.split('_')[0]}"
    query(sql)(run)


for _s, _q in (("fixed_size", _FIXED), ("structural", _HYBRID), ("hybrid", _HYBRID)):
    _chunk_query(_s, _q)


@query(f"""WITH RECURSIVE {LAWS}, o AS (SELECT doc_id, lang, {CLEAN} AS text FROM l WHERE {STRIP.format(CLEAN)} <> ''), {SEGMENTS},
m AS (SELECT doc_id, lang, text, lower(substring(text, 1, 2000)) AS low, substring(text, 1, 5000) AS s FROM o)
SELECT doc_id, lang, {_first_sql('substring(text, 1, 500)', K.DOC_TYPES)} AS doc_type, {_first_sql('substring(text, 1, 1000)', K.INSTITUTIONS)} AS institution,
CASE WHEN {_any_sql('low', K.COMMON_LAW)} THEN 'common_law' WHEN contains(low, 'ohada') THEN 'ohada' WHEN {_any_sql('low', K.CIVIL_LAW)} THEN 'civil_law' END AS jurisdiction,
CASE WHEN regexp_matches(s, '{_NUM}') THEN regexp_extract(s, '{_NUM}', 3) || '-' || lpad(regexp_extract(s, '{_NUM}', 2), 2, '0') || '-' || lpad(regexp_extract(s, '{_NUM}', 1), 2, '0') {_MONTHS} END AS date_document,
length(s)::INT AS char_count, n_chunks FROM m JOIN (SELECT doc_id, count(*) AS n_chunks FROM h GROUP BY 1) USING (doc_id)""")
def ingest_documents(spark, sf_dir):
    """Clean, describe, cut: chunks of each document with its metadata."""
    about, chunks = chunking.ingest(laws(spark, sf_dir))
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return about.join(n, "doc_id").drop("date_valid")


# ---------------------------------------------------------------- questions


def _keywords_sql(table_):
    from quillon.functions.questions import _plain

    counts = {n: " + ".join(f"contains(s, {quote(_plain(w))})::INT" for w in words) for n, words in table_.items()}
    return ", ".join(f"{c} AS {n}" for n, c in counts.items()), list(counts)


def _intent_sql(table_):
    cols, names = _keywords_sql(table_)
    top = f"greatest({', '.join(names)})"
    return f"SELECT conv_id, turn, CASE WHEN oos THEN 'out_of_scope' " + " ".join(f"WHEN {n} = {top} AND {top} > 0 THEN '{n}'" for n in names) + f" ELSE 'factual_query' END AS intent FROM (SELECT *, {cols} FROM v WHERE {{0}})"


_OOS = word_sql("text", "|".join(K.OUT_OF_SCOPE))
_FR = f"regexp_matches(text, '[{K.ACCENTED}]')"


@query(f"WITH {QUESTIONS}, v AS (SELECT conv_id, turn, strip_accents(lower(text)) AS s, {_FR} AS fr, {_OOS} AS oos FROM u) {_intent_sql(K.INTENTS_FR).format('fr')} UNION ALL {_intent_sql(K.INTENTS_EN).format('NOT fr')}")
def intent(spark, sf_dir):
    c = F.col("text")
    return asked(spark, sf_dir).select("conv_id", "turn", q.intent(c, t.language_heuristic(c)).alias("intent"))


_KINDS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {quote('(?i)(' + p + ')')}) THEN '{n}' END" for n, p in K.INJECTIONS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, {_KINDS} AS kinds, regexp_matches(text, {quote('(?i)(' + K.GATE + ')')}) AS gated FROM u")
def injection_flags(spark, sf_dir):
    c = F.col("text")
    return asked(spark, sf_dir).select("conv_id", "turn", F.array_join(q.injections(c), ",").alias("kinds"), q.gate(c).alias("gated"))


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, {_OOS} AS out_of_scope FROM u")
def out_of_scope(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", q.out_of_scope(F.col("text")).alias("out_of_scope"))


_EXPAND = "CASE " + " ".join(f"WHEN contains(lower(text), '{a}') AND NOT contains(lower(text), '{b}') THEN text || ' {b}'" for a, b in K.EXPANSIONS) + " ELSE text END"


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, {_EXPAND} AS expanded FROM u")
def query_expand(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", q.expand(F.col("text")).alias("expanded"))


_ENTITIES = [r"(?:^|[^\pL\pN_])(artice?l[e]?\s+[0-9]+)", r"(?:^|[^\pL\pN_])((?:loi|décret|arrêté|ordonnance|code)\s+(?:n[°o°]\s*)?[\pL\pN_/-]+)", r"(?:^|[^\pL\pN_])(Nord-Ouest|Sud-Ouest|Northwest|Southwest|NW|SW|Centre|Littoral|Ouest|Nord|Adamaoua|Est|Sud)(?:$|[^\pL\pN_])"]


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i){p}', 1)" for p in _ENTITIES) + ")))[1:10], '|') AS entities FROM u")
def entities(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", F.array_join(q.entities(F.col("text")), "|").alias("entities"))


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, length(text) BETWEEN 3 AND 2000 AS valid, CASE WHEN length(text) < 3 THEN 'too short' WHEN length(text) > 2000 THEN 'too long' ELSE '' END AS reason FROM u")
def query_valid(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", q.valid_length(F.col("text")).alias("v")).select("conv_id", "turn", "v.*")


_NAME = "string_split(url, '/')[-1] || ([' ', '.pdf', '.TXT', '.exe', '/../x.md'])[(page_id % 5 + 1)::INT]"


@query(f"""SELECT page_id, reason = '' AS valid, reason FROM (SELECT page_id, CASE WHEN regexp_matches(f, '(?i){K.INJECTIONS["path_traversal"]}') THEN 'traversal'
WHEN lower(regexp_extract(f, '\\.([^.]*)$', 1)) NOT IN ('pdf', 'txt', 'md', 'docx') THEN 'extension' WHEN length(f) > 255 THEN 'length' ELSE '' END AS reason FROM (SELECT page_id, {_NAME} AS f FROM pages))""")
def filename_valid(spark, sf_dir):
    from quillon.plans.inputs import phrase

    p = table(spark, sf_dir, "pages")
    f = F.concat(F.element_at(F.split("url", "/"), -1), phrase(F.col("page_id"), [" ", ".pdf", ".TXT", ".exe", "/../x.md"]))
    return p.select("page_id", q.valid_filename(f).alias("v")).select("page_id", "v.valid", "v.reason")


@query(f"SELECT doc_id, CASE WHEN {_FR} THEN 'fr' ELSE 'en' END AS language FROM documents")
def lang_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.language_heuristic(F.col("text")).alias("language"))


def _share_sql(lang):
    return f"len(list_filter(w, lambda x: x IN ({', '.join(map(quote, t.FUNCTION_WORDS[lang]))})))"


@query(f"""WITH w AS (SELECT doc_id, length(text) >= 20 AS long, {terms_sql('text')} AS w FROM documents), n AS (SELECT doc_id, long, {_share_sql('fr')} AS nf, {_share_sql('en')} AS ne FROM w),
s AS (SELECT doc_id, long, CASE WHEN nf + ne > 0 THEN nf::DOUBLE / (nf + ne) ELSE 0.0 END AS fr, CASE WHEN nf + ne > 0 THEN ne::DOUBLE / (nf + ne) ELSE 0.0 END AS en FROM n)
SELECT doc_id, CASE WHEN long AND en > fr THEN 'en' ELSE 'fr' END AS language, CASE WHEN long THEN greatest(fr, en) ELSE 0.0 END AS confidence, long AND fr >= 0.3 AND en >= 0.3 AS bilingual FROM s""")
def lang_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.detect_language(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("SELECT doc_id, sha256(text)[1:16] AS hash FROM documents")
def query_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.query_hash(F.col("text")).alias("hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def file_dedup(spark, sf_dir):
    return store.dedup(table(spark, sf_dir, "documents"), "text", "doc_id")


@query()
def embed_documents(spark, sf_dir):
    """Unit vectors of all documents by the default embedder; null for texts without words."""
    from quillon.functions import models

    d = table(spark, sf_dir, "documents").select("doc_id", models.embed(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))
