"""Registered queries of the clinical operators on the driver's tables.

SQL has the same meaning in DuckDB's dialect: lambdas are `lambda x: ...`, and
its regex engine has no lookaround and an ASCII \\b, so patterns spell out
letters where that matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions import text as X
from vitrail.functions.fuzzy import partial_ratio_col, ratio_col, token_set_ratio_col
from vitrail.operators import assemble, audit, codes, context, dedup, entities, lexical, pages, pii, sections, segments, spans, stats, store, validate
from vitrail.sources import files
from vitrail.sources.files import synthetic_cases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def _sql_text(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """An inline table for the SQL side."""
    body = ", ".join("(" + ", ".join(map(_sql_text, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


# --- text functions ---------------------------------------------------------

NORM = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, length({NORM}) AS n, sha256({NORM}) AS h FROM documents")
def normalize_text(spark, sf_dir):
    n = X.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).alias("n"), F.sha2(F.encode(n, "UTF-8"), 256).alias("h"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+', ' ', 'g'))) AS h
           FROM documents""")
def fold_flatten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(X.flatten(F.col("text")), "UTF-8"), 256).alias("h"))


@query(f"""SELECT doc_id, len(t) AS n, sha256(array_to_string(list_sort(t), ' ')) AS h FROM (
    SELECT doc_id, list_distinct(list_transform(list_filter(string_split_regex({NORM}, '[^a-z0-9]+'), lambda x: x <> ''),
        lambda x: CASE WHEN length(x) >= 4 AND x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END)) AS t FROM documents)""")
def token_set(spark, sf_dir):
    t = X.code_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("h"))


@query(f"""SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, list_filter(string_split_regex({NORM}, '[^a-z0-9]+'),
    lambda x: length(x) >= 2 AND NOT list_contains(string_split('{T.DEDUP_STOP_WORDS}', ' '), x)) AS t FROM documents)""")
def content_tokens(spark, sf_dir):
    t = X.content_tokens(X.normalize(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


@query(r"""SELECT doc_id, len(i) AS n, sha256(array_to_string(i, '|')) AS h FROM (SELECT doc_id, list_filter(list_transform(
    string_split_regex(regexp_replace(text, '([.;])\s+', '\1' || chr(10), 'g'), '\n'), lambda x: trim(x, ' .;:-•' || chr(9))), lambda x: length(x) >= 3) AS i
    FROM documents)""")
def item_split(spark, sf_dir):
    i = X.items(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(i).cast("long").alias("n"), F.sha2(F.encode(F.array_join(i, "|"), "UTF-8"), 256).alias("h"))


@query(r"""SELECT doc_id, nullif(concat_ws(' ', nullif(regexp_extract(text, '(?i)\d+[.,]?\d*\s*(?:mg|g|µg|ug|ml|ui|%)'), ''),
    nullif(regexp_extract(text, '(?i)(?:matin et soir|matin|soir|midi|par jour|/j|x\s?\d|fois par jour|par semaine|a jeun|à jeun)'), '')), '') AS dosage
    FROM documents""")
def dose_parse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.dosage(F.col("text")).alias("dosage"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS value_hash, 'doc_' || substr(sha256(text), 1, 12) AS document_id FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.short_hash(F.col("text")).alias("value_hash"), X.document_key(F.encode("text", "UTF-8")).alias("document_id"))


@query("SELECT count(*) AS files, sum(strlen(text)) AS bytes FROM documents WHERE strlen(text) <= 5000")
def size_limit(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").where(n <= 5000).agg(F.count(F.lit(1)).alias("files"), F.sum(n.cast("long")).alias("bytes"))


LABELS = [(r[0], r[1]) for r in T.rows(T.ICD10)] + [(r[0], r[1]) for r in T.rows(T.ATC)]


@query(rf"""SELECT code, trim(regexp_replace(regexp_replace(libelle, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS noyau,
    array_to_string(list_filter(list_transform(string_split(regexp_extract(libelle, '\(([^)]*)\)', 1), '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS alias
    FROM {values(LABELS, "code, libelle")}""")
def label_parts(spark, sf_dir):
    c = F.col("libelle")
    core = F.trim(F.regexp_replace(X.label_core(c), r"\s+", " "))
    return spark.createDataFrame(LABELS, "code string, libelle string").select("code", core.alias("noyau"), F.array_join(X.label_aliases(c), "|").alias("alias"))


@query(f"""SELECT code, array_to_string(CASE WHEN contains(code, '.') OR length(code) <= 3 THEN CASE WHEN contains(code, '.') THEN [left(code, 3)] ELSE [] END
    ELSE list_transform(list_filter([5, 4, 3, 1], lambda n: n < length(code)), lambda n: left(code, n)) END, ' ') AS parents
    FROM {values([(c,) for c, _ in LABELS], "code")}""")
def code_parents(spark, sf_dir):
    c = F.col("code")
    p = F.when(c.contains(".") | (F.length(c) <= 3), X.icd10_parents(c)).otherwise(X.atc_parents(c))
    return spark.createDataFrame([(c,) for c, _ in LABELS], "code string").select("code", F.array_join(p, " ").alias("parents"))


CASES = [("Acid", "acide"), ("ULCERE", "ulcère"), ("ulcere", "ulcère"), ("Hta", "hta"), ("X", "y")]


@query(f"""SELECT o, CASE WHEN upper(o) = o THEN upper(c) WHEN upper(left(o, 1)) = left(o, 1) THEN upper(left(c, 1)) || lower(substr(c, 2)) ELSE c END AS shown
    FROM {values(CASES, "o, c")}""")
def display_case(spark, sf_dir):
    return spark.createDataFrame(CASES, "o string, c string").select("o", X.apply_case(F.col("o"), F.col("c")).alias("shown"))


MARKED = [(1, "<|det|>title [1, 2, 3, 4]<|/det|>Compte rendu\n\n  <|det|>text [0]<|/det|> Suite  "), (2, "rien"), (3, "[a]\n[b]")]


@query(rf"""SELECT id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '<\|/?det\|>|\[[^\]]*\]', '', 'g'))),
    lambda x: x <> ''), chr(10)) AS t FROM {values(MARKED, "id, t")}""")
def strip_markers(spark, sf_dir):
    return spark.createDataFrame(MARKED, "id int, t string").select("id", X.strip_markers(F.col("t")).alias("t"))


@query("SELECT doc_id, length(t) AS n, sha256(t) AS t_sha256 FROM (SELECT doc_id, rtrim(text, ' .,;:') AS t FROM documents)")
def strip_trailing(spark, sf_dir):
    """The whole text, where `strip_trailing` and its SQL take 60 characters."""
    t = table(spark, sf_dir, "documents").select("doc_id", X.strip_trailing(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2(F.encode("t", "UTF-8"), 256).alias("t_sha256"))


LOG_LINE = ("user ", " tel 0612345678 at u", "@mail.example.fr nir 1 85 05 78 006 084 36 rpps 10001234567 de [PATIENT_001]")
_LOG_RULES = ((r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", "[NIR]"), (r"\b0[1-9](?:[\s.\-]?\d{2}){4}\b", "[TEL]"), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"),
              (r"\b10\d{9}\b", "[RPPS]"), (r"\b\d{9}\b", "[NUM9]"), (r"\[(?:PATIENT|NIR|RPPS|TEL|EMAIL)_\d{3}\]", "[TOKEN]"))
_LOG_SQL = f"'{LOG_LINE[0]}' || lpad(CAST(user_id AS VARCHAR), 9, '1') || '{LOG_LINE[1]}' || user_id || '{LOG_LINE[2]}'"
for _rx, _kind in _LOG_RULES:
    _LOG_SQL = f"regexp_replace({_LOG_SQL}, '{_rx}', '{_kind}', 'g')"


@query(f"SELECT event_id, {_LOG_SQL} AS line FROM events")
def log_redaction(spark, sf_dir):
    """Log lines with an identifier of every kind."""
    u = F.col("user_id").cast("string")
    line = F.concat(F.lit(LOG_LINE[0]), F.lpad(u, 9, "1"), F.lit(LOG_LINE[1]), u, F.lit(LOG_LINE[2]))
    return table(spark, sf_dir, "events").select("event_id", X.redact_log(line).alias("line"))


# --- identifiers ------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
EMAIL_RX = rf"{W}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.]*{W}"
SPANS_SQL = """SELECT doc_id, i, m[i] AS value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS m, string_split_regex(text, '{rx}') AS p FROM documents))"""


def _email(text: Column) -> Column:
    return spans.regex_spans(text, next(p[1] for p in pii.PATTERNS if p[0] == "EMAIL"))


@query(f"SELECT doc_id, s AS debut, s + length(value) AS fin, value FROM ({SPANS_SQL.format(rx=EMAIL_RX)})")
def pii_email_spans(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(_email(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.start").cast("long").alias("debut"), F.col("s.end").cast("long").alias("fin"), "s.value")


@query("SELECT count(*) AS spans, sum(s) AS debuts, count(*) AS anchored FROM (" + SPANS_SQL.format(rx=EMAIL_RX) + ")")
def span_anchors(spark, sf_dir):
    """Every span's value is the text at its offsets, and where they are."""
    s = table(spark, sf_dir, "documents").select("text", F.explode(_email(F.col("text"))).alias("s"))
    at = spans.sub(F.col("text"), F.col("s.start"), F.col("s.end") - F.col("s.start"))
    return s.agg(F.count(F.lit(1)).alias("spans"), F.sum("s.start").alias("debuts"), F.count_if(at == F.col("s.value")).alias("anchored"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL_RX}', '[REDACTED:EMAIL]', 'g')) AS h FROM documents")
def pii_redact_hash(spark, sf_dir):
    typed = F.transform(_email(F.col("text")), lambda s: F.struct(F.lit("EMAIL").alias("pii_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(pii.redact(F.col("text"), typed), "UTF-8"), 256).alias("h"))


@query(rf"""SELECT t.pii_type, count(d.n) AS n FROM (VALUES ('EMAIL'), ('TELEPHONE'), ('RPPS')) AS t(pii_type) LEFT JOIN (
    SELECT 'EMAIL' AS k, unnest(regexp_extract_all(text, '{EMAIL_RX}')) AS n FROM documents UNION ALL
    SELECT 'TELEPHONE', unnest(regexp_extract_all(' ' || text || ' ', '[^\p{{L}}\p{{N}}_]0[1-9](?:[\s.\-]?\d{{2}}){{4}}[^\p{{L}}\p{{N}}_]')) FROM documents UNION ALL
    SELECT 'RPPS', unnest(regexp_extract_all(' ' || text || ' ', '[^\p{{L}}\p{{N}}_]10\d{{9}}[^\p{{L}}\p{{N}}_]')) FROM documents) d ON d.k = t.pii_type GROUP BY 1""")
def detector_counts(spark, sf_dir):
    """Matches of single detectors, types without any included."""
    picked = {("EMAIL", 0.97), ("TELEPHONE", 0.90), ("RPPS", 0.70)}
    found = F.concat(*(F.transform(spans.regex_spans(F.col("text"), rx, g), lambda s: F.lit(k)) for k, rx, g, c in _named(picked)))  # noqa: B023
    hits = table(spark, sf_dir, "documents").select(F.explode(found).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    kinds = spark.createDataFrame([(k,) for k, _ in sorted(picked)], "pii_type string")
    return kinds.join(hits, F.col("pii_type") == F.col("k"), "left").select("pii_type", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def _named(picked):
    return [p for p in pii.PATTERNS if (p[0], p[3]) in picked]


@query()
def pii_count_by_type(spark, sf_dir):
    """Flagship: all detectors, resolved, counted by type with small counts masked."""
    s = table(spark, sf_dir, "documents").select(F.explode(pii.pii_spans(F.col("text"))).alias("s")).groupBy("s.pii_type").agg(F.count(F.lit(1)).alias("c"))
    kinds = spark.createDataFrame([(k,) for k in T.TOKEN_PREFIX], "kind string")
    n = F.coalesce("c", F.lit(0))
    return kinds.join(s, F.col("kind") == F.col("pii_type"), "left").select(F.col("kind").alias("pii_type"), F.when((n == 0) | (n >= stats.MIN_COUNT), n).alias("n"), ((n > 0) & (n < stats.MIN_COUNT)).alias("masque"))


IDENTIFIED = "Patient : Jean DUPONT né le 14/05/1956\nTél : 06 12 34 56 78, mail p{}@courriel.fr\nDr Sophie LENOIR, RPPS : 10001234567\nRevu le 12/03/2024 : Jean DUPONT va bien."
REDACTED = "Patient : [REDACTED:NOM_PERSONNE] né le [REDACTED:DATE_NAISSANCE]\nTél : [REDACTED:TELEPHONE], mail [REDACTED:EMAIL]\nDr [REDACTED:NOM_PERSONNE], RPPS : [REDACTED:RPPS]\nRevu le 12/03/2024 : [REDACTED:NOM_PERSONNE] va bien."
TOKENED = "Patient : [PATIENT_001] né le [DATE_NAISSANCE_001]\nTél : [TEL_001], mail [EMAIL_001]\nDr [PATIENT_002], RPPS : [RPPS_001]\nRevu le 12/03/2024 : [PATIENT_001] va bien."


def _filled(template: str) -> Column:
    a, b = template.split("{}")
    return F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b))


@query(f"SELECT doc_id, {_sql_text(REDACTED)} AS strict, {_sql_text(TOKENED)} AS pseudo, 6 AS n FROM documents")
def pii_literals(spark, sf_dir):
    """A report of every document's own: names, a birth date, a telephone, a mail, an RPPS, and a date that identifies no one."""
    d = table(spark, sf_dir, "documents").select("doc_id", _filled(IDENTIFIED).alias("text"))
    strict = pii.anonymize(d, "strict").select("doc_id", F.col("text").alias("strict"))
    pseudo = pii.anonymize(d).select(F.col("doc_id").alias("_d"), F.col("text").alias("pseudo"), F.size("pii_map").alias("n"))
    return strict.join(pseudo, F.col("doc_id") == F.col("_d")).drop("_d")


@query("SELECT count(*) AS documents, count(*) AS restored FROM documents")
def pseudonym_roundtrip(spark, sf_dir):
    d = pii.anonymize(table(spark, sf_dir, "documents").withColumn("raw", F.col("text")))
    back = pii.depseudonymize(F.col("text"), F.col("pii_map"))
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count_if(back == F.col("raw")).alias("restored"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce('[EMAIL_' || lpad(CAST(list_position(d, k[i]) AS VARCHAR), 3, '0') || ']', '')), '')) AS h, len(d) AS n
    FROM (SELECT *, list_filter(k, lambda x, i: list_position(k, x) = i) AS d FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{EMAIL_RX}'), lambda x: lower(trim(x))) AS k, string_split_regex(text, '{EMAIL_RX}') AS p FROM documents))""")
def pseudonym_email_hash(spark, sf_dir):
    """Every text with its e-mail addresses numbered in the order they first occur."""
    typed = F.transform(_email(F.col("text")), lambda s: F.struct(F.lit("EMAIL").alias("pii_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    d = table(spark, sf_dir, "documents").withColumn("pairs", pii.pseudonym_pairs(typed))
    h = F.sha2(F.encode(pii.pseudonymize(F.col("text"), F.col("pairs")), "UTF-8"), 256)
    return d.select("doc_id", h.alias("h"), F.size(F.array_distinct(F.transform("pairs", lambda p: p["token"]))).cast("long").alias("n"))


@query("""SELECT o_custkey AS dossier_id, 'EMAIL' AS prefix, key, '[EMAIL_' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d, k, key) AS VARCHAR), 3, '0') || ']' AS token
    FROM (SELECT o_custkey, lower(o_orderpriority) AS key, min((o_orderdate, o_orderkey)) AS f, f[1] AS d, f[2] AS k FROM orders GROUP BY 1, 2)""")
def pseudonym_tokens(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dossier_id"), F.lit("EMAIL").alias("pii_type"), F.col("o_orderpriority").alias("value"), "o_orderdate", "o_orderkey")
    return pii.dossier_tokens(s, order=("o_orderdate", "o_orderkey"))


@query(f"SELECT 'pii_detected' AS event, 'EMAIL' AS pii_type, 'regex' AS method, substr(sha256(value), 1, 16) AS value_hash, 'detect_only' AS action FROM ({SPANS_SQL.format(rx=EMAIL_RX)})")
def audit_value_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), pii.pattern_spans(F.col("text"))[1].alias("pii"))
    return pii.audit_entries(d, action="detect_only").select("event", "pii_type", "method", "value_hash", "action")


# --- pages ------------------------------------------------------------------


def _conversation_pages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text")


MAP_SQL = """SELECT conv_id AS document_id, turn AS page, CAST(sum(length(text) + 2) OVER w - 2 AS BIGINT) AS fin, CAST(sum(length(text) + 2) OVER w - 2 - length(text) AS BIGINT) AS debut
    FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


@query(MAP_SQL)
def page_offsets(spark, sf_dir):
    return pages.page_map(_conversation_pages(spark, sf_dir)).select("document_id", "page", F.col("fin").cast("long"), F.col("debut").cast("long"))


@query(f"""WITH m AS ({MAP_SQL}), e AS (SELECT document_id, unnest([0, 100, 500, 1000, 2000]) AS o FROM (SELECT DISTINCT document_id FROM m))
    SELECT e.document_id, CAST(e.o AS BIGINT) AS offset_debut, m.page FROM e LEFT JOIN m ON m.document_id = e.document_id AND e.o >= m.debut AND e.o < m.fin""")
def offset_to_page(spark, sf_dir):
    m = pages.page_map(_conversation_pages(spark, sf_dir))
    e = m.select("document_id").distinct().select("document_id", F.explode(F.array(*map(F.lit, (0, 100, 500, 1000, 2000))).cast("array<bigint>")).alias("offset_debut"))
    return pages.page_of(e, m).select("document_id", "offset_debut", "page")


@query("SELECT conv_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def joined_pages(spark, sf_dir):
    return pages.joined_text(_conversation_pages(spark, sf_dir))


@query(f"""SELECT document_id, abs(fin - (fin + 5 * document_id)) <= greatest(40, CAST(floor((fin + 5 * document_id) * 0.02) AS BIGINT)) AS valide
    FROM (SELECT document_id, max(fin) AS fin FROM ({MAP_SQL}) GROUP BY 1)""")
def page_map_valid(spark, sf_dir):
    m = pages.page_map(_conversation_pages(spark, sf_dir)).groupBy("document_id").agg(F.max("fin").alias("fin"))
    return m.select("document_id", pages.map_is_valid(F.col("fin"), F.col("fin") + 5 * F.col("document_id")).alias("valide"))


@query("""SELECT conv_id AS document_id, count(*) AS total, count_if(role <> 'user') AS ok, count_if(role = 'user') AS anomalies FROM conversations GROUP BY 1""")
def page_report(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.when(F.col("role") == "user", "x").alias("error"))
    return pages.page_report(p).withColumn("anomalies", F.size("anomalies").cast("long"))


PAGE_TEXTS = ("Antibiogramme : amoxicilline résistant", "Compte rendu de consultation, sans particularité")
_PAGES_SQL = """e AS (SELECT l_partkey % 500 AS d, l_linenumber AS p, l_returnflag FROM lineitem), n AS (SELECT d, p, count(*) AS n, count_if(l_returnflag = 'A') AS t FROM e GROUP BY 1, 2),
    bad AS (SELECT d, p, n, CASE WHEN (d + p) % 9 = 0 THEN 'antibiogramme' ELSE 'densite (' || t || ' traitements sur la page)' END AS motif FROM n WHERE (d + p) % 9 = 0 OR t > 10)"""


def _dense(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages with a text, and their entities: one page in nine is an antibiogram."""
    label = F.when(F.col("l_returnflag") == "A", "treatment").otherwise("problem").alias("label")
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("document_id"), F.col("l_linenumber").alias("page"), "l_returnflag", label)
    p = e.select("document_id", "page").distinct()
    return p.withColumn("text", F.when((F.col("document_id") + F.col("page")) % 9 == 0, PAGE_TEXTS[0]).otherwise(PAGE_TEXTS[1])), e


@query(f"WITH {_PAGES_SQL} SELECT d AS document_id, p AS page, n AS entites_supprimees, motif FROM bad")
def drop_dense_pages(spark, sf_dir):
    return pages.rejected_pages(*_dense(spark, sf_dir))


@query(f"WITH {_PAGES_SQL} SELECT l_returnflag, count(*) AS n FROM e WHERE (d, p) NOT IN (SELECT (d, p) FROM bad) GROUP BY 1")
def off_dense_pages(spark, sf_dir):
    p, e = _dense(spark, sf_dir)
    return pages.off_rejected_pages(e, pages.rejected_pages(p, e)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


FORMS = [("html",), ("doctype html",), ("charset",), ("title",), ("absent",), ("track",)]


@query(rf"""WITH z AS (SELECT page_id % 5 AS document_id, page_id AS page, trim(regexp_replace(lower(strip_accents(left(html, 200))), '\s+', ' ', 'g')) AS zone FROM pages),
    h AS (SELECT document_id, forme, page, instr(zone, forme) AS pos FROM z, {values(FORMS, "forme")} WHERE contains(zone, forme))
    SELECT document_id, forme, count(*) AS pages FROM (SELECT *, first_value(pos) OVER (PARTITION BY document_id, forme ORDER BY page) AS a FROM h)
    GROUP BY 1, 2 HAVING count(*) > 3 AND max(abs(pos - a)) <= 50""")
def header_repeat(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("document_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))
    f = p.select("document_id").distinct().withColumn("valeur", F.explode(F.array(*(F.lit(x) for (x,) in FORMS))))
    return pages.repeated_headers(f, p)


@query("""SELECT l_orderkey AS document_id, string_agg(t, chr(10) ORDER BY l_linenumber) AS text, round(sum(c) / sum(n), 3) AS confidence FROM (
    SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY w, CAST(l_partkey AS VARCHAR)) AS t, sum(l_quantity) AS c, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS w FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def ocr_line_rebuild(spark, sf_dir):
    w = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate"))
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.lit(0).alias("block"), F.lit(0).alias("par"), F.col("l_linenumber").alias("line"), w.alias("word"),
        F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("conf"),
    )
    return pages.line_rebuild(words, ("document_id",))


# --- entities ---------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id").cast("int"))


@query("""SELECT user_id, event_id, event_type, (SELECT max(t.event_id) FROM events t WHERE t.user_id = e.user_id AND t.event_type = 'signup' AND t.event_id <= e.event_id) AS titre_at
    FROM events e WHERE event_type <> 'signup'""")
def last_title_asof(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.col("event_id").alias("debut"), "event_type")
    h = e.where("event_type = 'signup'").select("document_id", F.col("debut").alias("at"), F.col("event_type").alias("titre"))
    out = entities.with_last_title(e.where("event_type <> 'signup'"), h)
    return out.select(F.col("document_id").alias("user_id"), F.col("debut").cast("long").alias("event_id"), "event_type", F.col("titre_at").cast("long").alias("titre_at"))


@query("""WITH t AS (SELECT user_id, event_id, nullif(event_type, 'view') AS ty, value FROM events), p AS (SELECT *, lag(ty) OVER w AS pt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(CAST(ty IS NOT NULL AND (pt IS NULL OR pt <> ty OR event_id % 3 = 0) AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM p)
    SELECT user_id, ty AS label, min(event_id) AS debut, max(event_id) + 1 AS fin, round(avg(value), 6) AS score FROM g WHERE ty IS NOT NULL GROUP BY user_id, n, ty""")
def bio_islands(spark, sf_dir):
    """Runs of one type; every third event has a B- label, which begins a mention past the last one's end."""
    t = _events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.nullif("event_type", F.lit("view")).alias("type"), F.col("value").alias("score"), (F.col("event_id") % 3 == 0).alias("is_b")
    )
    return entities.decode_bio(t, key="user_id").select("user_id", "label", F.col("debut").cast("long"), F.col("fin").cast("long"), F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT user_id, event_id, event_type AS ty, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events),
    g AS (SELECT *, sum(CAST(pt IS NULL OR pt <> ty AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM t)
    SELECT user_id, ty AS label, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS text, min(event_id) AS start, max(event_id) + 1 AS "end" FROM g GROUP BY user_id, n, ty""")
def label_runs(spark, sf_dir):
    w = _events(spark, sf_dir).select("user_id", F.col("event_id").cast("long").alias("i"), F.col("event_id").cast("string").alias("word"), F.concat(F.lit("I-"), "event_type").alias("label"))
    return entities.group_labels(w, key="user_id")


@query("""WITH i AS (SELECT user_id, event_id AS s, event_id + 60 AS e FROM events), p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i),
    g AS (SELECT *, sum(CAST(pe IS NULL OR s >= pe AS INT)) OVER (PARTITION BY user_id ORDER BY s) AS n FROM p) SELECT user_id, min(s) AS debut, max(e) AS fin FROM g GROUP BY user_id, n""")
def interval_merge(spark, sf_dir):
    return pages.merge_intervals(_events(spark, sf_dir).select("user_id", F.col("event_id").cast("long").alias("debut"), (F.col("event_id").cast("long") + 60).alias("fin")), "user_id")


@query("""SELECT e.user_id, e.event_id FROM events e WHERE e.event_type = 'click' AND NOT EXISTS (
    SELECT 1 FROM events t WHERE t.user_id = e.user_id AND t.event_type = 'error' AND t.event_id < e.event_id + 30 AND e.event_id < t.event_id + 30)""")
def anti_join_tokens(spark, sf_dir):
    """Range anti-join: clicks that no error's span overlaps."""
    e = _events(spark, sf_dir)
    span = (F.col("event_id").alias("debut"), (F.col("event_id") + 30).alias("fin"))
    clicks, errors = (e.where(F.col("event_type") == k).select("user_id", *span) for k in ("click", "error"))
    return pages.without_overlaps(clicks, errors, "user_id").select("user_id", F.col("debut").cast("long").alias("event_id"))


def _cases(spark, sf_dir, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """doc_id and the fields of the case that the document is given, by its id."""
    kind = F.pmod(F.col("doc_id"), F.lit(len(rows))).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", *(F.get(F.array(*(F.lit(r[i]).cast("string") for r in rows)), kind).alias(n) for i, n in enumerate(names))
    )


def _cases_sql(rows: list[tuple], at: int, name: str) -> str:
    return f"SELECT doc_id, v.{name} FROM documents JOIN {values([(i, r[at]) for i, r in enumerate(rows)], f'i, {name}')} ON doc_id % {len(rows)} = i"


#: Text, entity, and how its context qualifies it.
CONTEXTS = [
    ("Pas de fièvre. Douleur thoracique", "Douleur", "aucun"), ("IL n'est pas exclu qu'il se soit agi d'un abcès", "abcès", "nuance"),
    ("sans anomalie décelée, et qui lui prescrit du CLAMOXYL", "CLAMOXYL", "aucun"), ("Absence de signe de malignité", "malignité", "niee"),
    ("pas de signe d'IVG ni de phlébite", "phlébite", "niee"), ("antécédents familiaux de mort subite", "mort subite", "familial"),
    ("pas d’éléments pour expliquer cette symptomatologie", "symptomatologie", "aucun"), ("suspicion de phlébite", "phlébite", "hypothetique"),
    ("patient suivi pour HTA", "HTA", "aucun"),
]


@query(_cases_sql(CONTEXTS, 2, "verdict"))
def context_verdicts(spark, sf_dir):
    c = _cases(spark, sf_dir, CONTEXTS, ("t", "e", "want"))
    q = context.qualify(F.col("t"), F.call_function("locate", F.col("e"), F.col("t")) - 1)
    return c.select("doc_id", context.verdict(q).alias("verdict"))


#: Label, context, title, entity, and the section it goes to.
ROUTES = [
    ("treatment", "allergie à la", None, "", "allergies"),
    ("treatment", "intolérance au", None, "", "allergies"),
    ("treatment", "vaccination antigrippale", None, "", "vaccinations"),
    ("treatment", "antécédent de", None, "", "antecedents"),
    ("treatment", "opéré en 2003", None, "", "antecedents"),
    ("treatment", "", "antecedents", "", "antecedents"),
    ("treatment", "cure de 7 jours", None, "", "points_vigilance"),
    ("treatment", "pendant 2 semaines", None, "", "points_vigilance"),
    ("treatment", "traitement en cours", None, "", "traitements_long_cours"),
    ("problem", "allergie à la", None, "", "allergies"),
    ("problem", "intolérance au", None, "", "allergies"),
    ("problem", "antécédent de", None, "", "antecedents"),
    ("problem", "chirurgical", None, "", "antecedents"),
    ("problem", "opéré en 2003", None, "", "antecedents"),
    ("problem", "en 2003", None, "", "antecedents"),
    ("problem", "", "antecedents", "", "antecedents"),
    ("problem", "Tabagisme, consommation d'alcool", None, "Tabagisme", "facteurs_risque"),
    ("problem", "poids 92 kg", None, "poids 92 kg", "pathologies_actives"),
    ("problem", "activité physique réduite", None, "activité physique réduite", "facteurs_risque"),
    ("problem", "sevrage tabagique progressif", None, "sténose urétrale", "pathologies_actives"),
    ("problem", "", "facteurs_risque", "IMC 32", "facteurs_risque"),
    ("problem", "douleur", None, "", "pathologies_actives"),
    ("test", "", None, "", "points_vigilance"),
    ("treatment", "excision du pertuis cutané", None, "excision du pertuis cutané", "antecedents"),
    ("treatment", "", None, "cholécystectomie rétrograde", "antecedents"),
    ("treatment", "", None, "Metformine", "traitements_long_cours"),
]


@query(_cases_sql(ROUTES, 4, "section"))
def routing_table(spark, sf_dir):
    c = _cases(spark, sf_dir, ROUTES, ("label", "c", "t", "v", "want"))
    return c.select("doc_id", entities.route(F.col("label"), F.col("c"), F.col("t"), F.col("v")).alias("section"))


#: A joined value, its offset, and its parts with theirs.
JOINED = [("HTA Gastrite chronique", 100, "HTA@100-103|Gastrite chronique@104-122"), ("rien", 5, "rien@5-9")]


@query(_cases_sql(JOINED, 2, "parts"))
def joined_items_split(spark, sf_dir):
    c = _cases(spark, sf_dir, JOINED, ("v", "a", "want"))
    part = lambda p: F.concat(p["value"], F.lit("@"), p["debut"].cast("string"), F.lit("-"), p["fin"].cast("string"))
    return c.select("doc_id", F.array_join(F.transform(entities.split_joined(F.col("v"), F.col("a").cast("int")), part), "|").alias("parts"))


DOSED = [(1, "OGAST 1 gél/j en permanence.", 5), (2, "RAMIPRIL 5 mg matin et soir", 8), (3, "HTA sévère", 3), (4, "X" + " matin" * 20, 1)]


@query(rf"""SELECT id, CAST(fin + least(60, length(regexp_extract(substr(t, fin + 1, 120), '{entities.POSOLOGY.replace("(?iuU)", "(?i)")}'))) AS INT) AS fin
    FROM {values(DOSED, "id, t, fin")}""")
def posology_extension(spark, sf_dir):
    df = spark.createDataFrame(DOSED, "id int, t string, fin int")
    return df.select("id", entities.extended_end(F.col("t"), F.col("fin")).alias("fin"))


# --- sections, codes, fuzzy, dedup: fixture-checked in tests --------------------


ZONED = [
    ("a", "ANTÉCÉDENTS : HTA\nAllergies: Pénicilline\nTRAITEMENTS EN COURS\nRamipril 5 mg\nCONCLUSION : stable\nreste"), ("b", "rien"),
    ("c", "Motif : toux\n  Facteurs de risque : tabac\nVaccins : grippe"), ("d", "POINTS DE VIGILANCE : chute\nOBSERVATIONS\nANTÉCÉDENT : asthme"),
]
_HEADS = [*((k, rf"(?im)^\s*(?:{v})\s*:?\s*") for k, v in sections.HEADINGS.items()), ("", r"(?im)^\s*(?:CONCLUSIONS?|OBSERVATIONS?)\b")]
_MARKS = " UNION ALL ".join(
    f"SELECT id, t, {i} AS rank, '{k}' AS section, unnest(range(1, len(regexp_extract_all(t, '{rx}')) + 1)) AS i, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS p FROM v"
    for i, (k, rx) in enumerate(_HEADS)
)


@query(f"""WITH v AS (SELECT * FROM {values(ZONED, "id, t")}), x AS ({_MARKS}), y AS (SELECT id, t, rank, section, list_sum(list_transform(p[1:i], lambda z: length(z)))
        + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS pos, length(m[i]) AS n FROM x),
    b AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY rank) AS k FROM y), z AS (SELECT id, t, section, CAST(pos + n AS INT) AS debut,
        CAST(coalesce(lead(pos) OVER (PARTITION BY id ORDER BY pos), length(t)) AS INT) AS fin FROM b WHERE k = 1)
    SELECT id AS document_id, section, debut, fin, substr(t, debut + 1, fin - debut) AS texte FROM z WHERE section <> ''""")
def section_zones(spark, sf_dir):
    return sections.section_zones(spark.createDataFrame(ZONED, "document_id string, text string"))


SECTIONED = "ALLERGIES : Pénicilline, dossier {}.\nTRAITEMENTS : Ramipril 5 mg; Doliprane\nCONCLUSION : revoir"


@query("""WITH d AS (SELECT doc_id, 'Pénicilline, dossier ' || doc_id AS a FROM documents), r AS (
    SELECT doc_id, 'allergies' AS section, a AS valeur, 0.8 AS confiance, 12 AS debut FROM d
    UNION ALL SELECT doc_id, 'traitements_long_cours', 'Ramipril 5 mg', 0.88, 12 + length(a) + 16 FROM d
    UNION ALL SELECT doc_id, 'traitements_long_cours', 'Doliprane', 0.6, 12 + length(a) + 31 FROM d)
    SELECT doc_id, section, valeur, CAST(confiance AS DOUBLE) AS confiance, CAST(debut AS INT) AS offset_debut, CAST(debut + length(valeur) AS INT) AS offset_fin FROM r""")
def section_items_scored(spark, sf_dir):
    """Zones, items and their confidences in a report of each document's own."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), _filled(SECTIONED).alias("text"))
    found = sections.scored_items(sections.section_zones(d))
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "section", "valeur", F.round("confiance", 2).alias("confiance"), "offset_debut", "offset_fin")


@query()
def rules_with_fallback(spark, sf_dir):
    return sections.extract_rules(synthetic_cases(spark))


#: Reports that vary by document, and what the fallback must find in them: (section, value, confidence, what is before the value).
FREE = [
    ("CONCLUSION :\nBilan {} stable.\nContrôle dans six mois.", [("points_vigilance", "Bilan {} stable", 0.75, "CONCLUSION :\n"), ("points_vigilance", "Contrôle dans six mois", 0.75, "CONCLUSION :\nBilan {} stable.\n")]),
    ("Bonjour.\nTabagisme actif, dossier {}\nfin", [("facteurs_risque", "Tabagisme actif, dossier {}", 0.65, "Bonjour.\n")]),
    ("Vu ce jour.\n  Rappel vaccin 2019 lot {}\nfin", [("vaccinations", "Rappel vaccin 2019 lot {}", 0.6, "Vu ce jour.\n  ")]),
    ("Numéro {}, rien à dire.", []),
]
_FREE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {_sql_text(section)} AS section, {v} AS valeur, {confidence} AS confiance, CAST(length({at}) AS INT) AS offset_debut, CAST(length({at}) + length({v}) AS INT) AS offset_fin "
    f"FROM documents WHERE doc_id % {len(FREE)} = {i}"
    for i, (_, found) in enumerate(FREE)
    for section, value, confidence, before in found
    for v, at in [(f"replace({_sql_text(value)}, '{{}}', CAST(doc_id AS VARCHAR))", f"replace({_sql_text(before)}, '{{}}', CAST(doc_id AS VARCHAR))")]
)


@query(f"SELECT doc_id, section, valeur, CAST(confiance AS DOUBLE) AS confiance, offset_debut, offset_fin FROM ({_FREE_SQL})")
def free_text_on_documents(spark, sf_dir):
    """Every fallback extractor over a report of each document's own."""
    kind = F.pmod(F.col("doc_id"), F.lit(len(FREE)))
    text = F.coalesce(*(F.when(kind == i, _filled(t)) for i, (t, _) in enumerate(FREE)))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), text.alias("text"))
    found = sections.extract_rules(d)
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "section", "valeur", "confiance", "offset_debut", "offset_fin")


#: Labelled terms: every document is given one, by its id.
TERMS = [
    ("insuffisance cardiaque", "I50"), ("insuffisance cardiaque droite", "I50"), ("insuffisance rénale", None), ("insuffisance rénale chronique", "N18"),
    ("zygarthrose", None), ("fibrillation auriculaire", "I48"), ("AVC", None), ("AVC ischémique", "I63"), ("diabète", None), ("tumeur", None), ("anémie", None),
    ("cirrhose", None), ("lombalgie", None), ("diabète de type 2", "E11"), ("infarctus du myocarde", "I21"), ("BPCO", "J44"), ("pacemaker", "Z95.0"), ("allergie", "T78.4"),
]
DRUGS = [
    ("SPIRAMYCINE", None), ("LODOZ 5 mg", None), ("TRAMADOL 50 mg", None), ("Kardegic 75mg", "B01AC06"), ("Aspirine 75 mg", "B01AC06"),
    ("Pantoprazole 20mg : 1/j", "A02BC02"), ("Amlodipine 10mg : 1/j", "C08CA01"), ("PARACETAMOL 500 mg 2 gélules", "N02BE01"),
    ("Metformine 1000 mg matin et soir", "A10BA02"), ("Zorglubine 3 mg", None),
]


def _labelled_sql(rows: list) -> str:
    return f"SELECT doc_id, valeur, code FROM documents JOIN {values([(i, *r) for i, r in enumerate(rows)], 'i, valeur, code')} ON doc_id % {len(rows)} = i"


def _coded(spark, sf_dir, rows: list, section: str) -> DataFrame:
    value = F.get(F.array(*(F.lit(t) for t, _ in rows)), F.pmod(F.col("doc_id"), F.lit(len(rows))).cast("int"))
    f = table(spark, sf_dir, "documents").select("doc_id", F.lit(section).alias("section"), value.alias("valeur"))
    return codes.attach_codes(f).select("doc_id", "valeur", "code_normalise.code")


@query(_labelled_sql(TERMS))
def fuzzy_best_code(spark, sf_dir):
    return _coded(spark, sf_dir, TERMS, "pathologies_actives")


@query(_labelled_sql(DRUGS))
def fuzzy_best_drug(spark, sf_dir):
    return _coded(spark, sf_dir, DRUGS, "traitements_long_cours")


@query()
def code_attachment(spark, sf_dir):
    f = sections.extract_rules(synthetic_cases(spark))
    return codes.attach_codes(f).select("document_id", "section", "valeur", "code_normalise.code", "code_normalise.a_verifier", "dosage")


@query(f"""WITH t AS (SELECT code FROM {values([(c,) for c, _ in LABELS], "code")}), x AS (SELECT code, unnest(CASE WHEN contains(code, '.') OR length(code) <= 3 THEN
    CASE WHEN contains(code, '.') THEN [left(code, 3)] ELSE [] END ELSE [left(code, n) FOR n IN [5, 4, 3, 1] IF n < length(code)] END) AS p FROM t)
    SELECT t.code, (SELECT max(x.p) FROM x WHERE x.code = t.code AND x.p IN (SELECT code FROM t)) AS parent FROM t""")
def code_parent_lookup(spark, sf_dir):
    t = spark.createDataFrame([(c,) for c, _ in LABELS], "code string")
    return codes.parent_lookup(t, t)


VERDICTS = [("I50", "I50"), ("E11", "E11.9"), ("N18", "I50"), ("J44", None), ("E78.0", "E78"), (None, "I10")]


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN got IS NULL THEN 'ABSENCE' WHEN want IS NOT NULL AND (starts_with(got, want) OR starts_with(want, got)) THEN 'CORRECT' ELSE 'FAUX' END AS verdict
    FROM {values(VERDICTS, "want, got")}) GROUP BY 1""")
def code_verdicts(spark, sf_dir):
    df = spark.createDataFrame(VERDICTS, "want string, got string")
    return df.select(codes.audit_verdict(F.col("want"), F.col("got")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


#: Values in order of arrival with their pages: misread chains meet, opposite sides do not.
REPEATED = [
    ("Ulcère bulbaire linéaire", 8), ("ulcère libéaire", 22), ("ulcère linéaire", 30), ("Ulcère bulbaire", 40), ("ulcère bulbmre", 55), ("hernie inguinale droite", 60),
    ("hernie inguinale gauche", 61), ("hernie inguinale", 62), ("kyste hépatique", 70), ("kyste urétral", 71),
]
MERGED = [
    ("Ulcère bulbaire linéaire", 5, "8,22,30,40,55", False), ("hernie inguinale droite", 2, "60,62", True), ("hernie inguinale gauche", 1, "61", True),
    ("kyste hépatique", 1, "70", False), ("kyste urétral", 1, "71", False),
]


@query(f"SELECT doc_id, valeur, CAST(occurrences AS INT) AS occurrences, pages, CAST(d AS BOOLEAN) AS lateralite_divergente FROM documents, {values([(a, b, c, int(d)) for a, b, c, d in MERGED], 'valeur, occurrences, pages, d')}")
def semantic_dedup(spark, sf_dir):
    """The same ten mentions in every document, shuffled, to five fields."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(v).alias("valeur"), F.lit(p).alias("page")) for i, (v, p) in enumerate(REPEATED)))
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.explode(rows).alias("r")).select("document_id", "r.*")
    f = f.select("document_id", F.lit("pathologies_actives").alias("section"), "ord", "valeur", F.lit(0.9).alias("confiance"), "page", F.col("valeur").alias("passage"), F.lit(None).cast("string").alias("code"))
    d = dedup.deduplicate(f)
    pages_ = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return d.select(F.col("document_id").cast("long").alias("doc_id"), "valeur", "occurrences", pages_.alias("pages"), "lateralite_divergente")


MISREAD = [
    ("Oesophagite et ulcere bulbaire", "Œsophagite et ulcère bulbaire"), ("GASTRIQEU", "GASTRIQUE"), ("rien a voir 500mg", "rien a voir 500mg"),
    ("Hypertensio arterielle", "Hypertension artérielle"),
]


@query(f"SELECT doc_id, v AS valeur, c AS correction_ocr FROM (SELECT doc_id, v, CAST(c AS BOOLEAN) AS c FROM documents JOIN {values([(i, b, int(a != b)) for i, (a, b) in enumerate(MISREAD)], 'i, v, c')} ON doc_id % {len(MISREAD)} = i)")
def lexical_correct(spark, sf_dir):
    value = F.get(F.array(*(F.lit(a) for a, _ in MISREAD)), F.pmod(F.col("doc_id"), F.lit(len(MISREAD))).cast("int"))
    return lexical.correct(table(spark, sf_dir, "documents").select("doc_id", value.alias("valeur")), "valeur", "doc_id")


#: Published values of the kernel.
SCORES = [
    ("achilie", "achille", "ratio", 85.7), ("ulcere libeaire", "ulcere bulbaire lineaire", "token_set", 71.8), ("ulcere libeaire", "ulcere lineaire", "token_set", 93.3),
    ("ulcere bulbmre", "ulcere bulbaire", "token_set", 89.7), ("insuffisance cardiaque", "insuffisance renale", "token_set", 78.0), ("bulbaire", "ulcere bulbaire lineaire", "partial", 100.0),
]


@query(f"SELECT a, b, kernel, CAST(score AS DOUBLE) AS score FROM {values(SCORES, 'a, b, kernel, score')}")
def fuzzy_scores(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame([r[:3] for r in SCORES], "a string, b string, kernel string")
    score = F.when(F.col("kernel") == "ratio", ratio_col(a, b)).when(F.col("kernel") == "partial", partial_ratio_col(a, b)).otherwise(token_set_ratio_col(a, b))
    return rows.select("a", "b", "kernel", F.round(score, 1).alias("score"))


# --- validation -------------------------------------------------------------


#: One section of each kind that the rules tell apart.
RULE_SECTIONS = ("points_vigilance", "pathologies_actives", "traitements_long_cours")
CUES = r"(?iuU)(?:" + "|".join(x.removeprefix("(?iuU)") for x in (context.NEGATED, context.FAMILY, context.HYPOTHETICAL, context.WEAKLY_NEGATED)) + r")\s*(?:(?:de|du|des)\s+|d['’]\s*)?"


def _item_rows(d: DataFrame) -> DataFrame:
    """The items of every document (document_id, text), each its own passage, at their offsets."""
    d = d.withColumn("text_norm", X.normalize(F.col("text")))  # below the explode: once per document
    it = d.select("document_id", "text", "text_norm", F.explode(sections.item_spans(F.col("text"))).alias("i"))
    return it.select("document_id", "text", "text_norm", F.col("i.value").alias("valeur"), F.col("i.value").alias("passage"), F.col("i.start").alias("offset_debut"))


def _after_cues(items: DataFrame) -> DataFrame:
    """What follows each context cue of an item, at its offset: an item starts after a
    sentence end, so only what stands inside one has words to its left."""
    m = items.select("*", F.explode(spans.regex_spans(F.col("passage"), CUES)).alias("m"))
    m = m.withColumn("valeur", spans.sub(F.col("passage"), F.col("m.end"), F.length("passage")))
    return m.where(F.length("valeur") >= 3).withColumn("offset_debut", F.col("offset_debut") + F.col("m.end")).drop("m")


def _candidates(spark, sf_dir) -> DataFrame:
    """The items of every document as candidates for points_vigilance."""
    return _item_rows(docs(spark, sf_dir)).withColumn("section", F.lit("points_vigilance"))


def _all_candidates(d: DataFrame) -> DataFrame:
    """Items and what follows their cues, as candidates for a section of each kind."""
    it = _item_rows(d)
    return it.unionByName(_after_cues(it)).withColumn("section", F.explode(F.array(*map(F.lit, RULE_SECTIONS))))


ITEMS_SQL = r"""SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.;])\s+', '\1' || chr(10), 'g'), '\n'),
    lambda x: trim(x, ' .;:-•' || chr(9))), lambda x: length(x) >= 3)) AS v FROM documents"""


@query(rf"""SELECT count(*) AS n FROM (SELECT trim(v) AS v FROM ({ITEMS_SQL})) WHERE NOT (length(v) BETWEEN 3 AND 120) OR length(v) - length(replace(v, '.', '')) >= 2
    OR len(list_filter(string_split_regex(v, '\s+'), lambda x: x <> '')) > 18""")
def validate_lengths(spark, sf_dir):
    """Candidates that the length rule rejects."""
    _, rejects = validate.validate(_candidates(spark, sf_dir))
    return rejects.where("regle = 'validateur_longueur'").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS candidats, count(*) AS gardes_et_rejetes FROM ({ITEMS_SQL})")
def kept_plus_rejected(spark, sf_dir):
    """Every candidate gets one verdict: kept, or rejected by a named rule."""
    # one column of verdicts, so that each is reached once
    regle = validate.judged(_candidates(spark, sf_dir)).select(F.coalesce("_v.rejet.regle", F.lit("")).alias("regle"))
    kept, rejected = F.count_if(F.col("regle") == ""), F.count_if(F.col("regle") != "")
    return regle.agg(F.count(F.lit(1)).alias("candidats"), (kept + rejected).alias("gardes_et_rejetes"))


@query()
def context_after_cues(spark, sf_dir):
    """Verdicts on what follows each context cue of the documents' items, at its offset."""
    after = _after_cues(_item_rows(docs(spark, sf_dir)))
    v = context.verdict(context.qualify(F.col("text"), F.col("offset_debut")))
    return after.select(v.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query()
def reject_histogram(spark, sf_dir):
    return validate.reject_histogram(validate.validate(_all_candidates(docs(spark, sf_dir)))[1])


@query()
def entity_chain(spark, sf_dir):
    """Stand-in model to routed, filtered and coded entities."""
    d = synthetic_cases(spark)
    terms = [("infarctus du myocarde", "problem", 0.95), ("asthme", "problem", 0.9), ("pénicilline", "treatment", 0.85), ("ramipril", "treatment", 0.8), ("metformine", "treatment", 0.92), ("hypertension", "problem", 0.6)]
    e = entities.stitch(entities.gazetteer(d, terms), d)
    e = e.join(d, "document_id").withColumn("rejet", entities.entity_reject(F.col("text"))).where("rejet is null").drop("rejet", "text")
    return entities.routed(e, d).select("document_id", "label", "texte", "debut", "fin", "score", "titre", "section")


@query()
def summary_markdown(spark, sf_dir):
    """Rules, dedup, assembly and rendering, end to end."""
    f = sections.extract_rules(synthetic_cases(spark))
    w = Window.partitionBy("document_id", "section").orderBy("offset_debut", "valeur")
    f = f.withColumn("ord", F.row_number().over(w)).withColumn("page", F.lit(1)).withColumn("code", F.lit(None).cast("string"))
    return assemble.markdown(assemble.assemble(dedup.deduplicate(f).select("document_id", "section", "ord", "valeur", "confiance", "occurrences")))


# --- statistics -------------------------------------------------------------


@query("SELECT o_orderstatus AS statut, count(*) AS n FROM orders GROUP BY 1")
def stats_by_status(spark, sf_dir):
    return stats.count_by(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "statut"), "statut")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS mois, count(*) AS n FROM orders GROUP BY 1")
def stats_by_month(spark, sf_dir):
    return stats.by_month(table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")), "d")


@query("""SELECT o_custkey, o_orderpriority, CASE WHEN c >= 5 THEN c END AS n, c < 5 AS masque FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2
    ORDER BY c DESC, o_custkey, o_orderpriority LIMIT 10)""")
def top10_masked(spark, sf_dir):
    return stats.top_masked(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("SELECT l_returnflag AS section, round(avg(CAST(l_discount AS DECIMAL(18, 4))), 3) AS completude FROM lineitem GROUP BY 1")
def mean_confidence(spark, sf_dir):
    return stats.mean_confidence(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_discount").alias("confiance")))


@query("SELECT count_if(value < 5) AS low, count_if(value >= 5 AND value < 7) AS middle, count_if(value >= 7) AS high FROM events")
def score_buckets(spark, sf_dir):
    return stats.score_buckets(table(spark, sf_dir, "events").withColumn("score", F.when(F.col("value") < 5, 0.1).when(F.col("value") < 7, 0.6).otherwise(0.9)))


@query("""SELECT role AS label, count(*) AS n, count_if(length(text) < 4) AS fragments, round(avg(length(text)), 3) AS mean_length, round(avg(CAST(turn AS DOUBLE)), 3) AS mean_score,
    count_if(turn < 0.5) AS low, count_if(turn >= 0.5 AND turn < 0.7) AS middle, count_if(turn >= 0.7) AS high FROM conversations GROUP BY 1""")
def eval_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("label"), F.col("text").alias("texte"), F.col("turn").cast("double").alias("score"))
    return stats.evaluation_summary(c)


BENCH_NORM = NORM


@query(f"""SELECT engine, round(avg(levenshtein(translate(n, e, 'x'), n) / greatest(length(n), 1)), 4) AS cer, count(*) AS runs
    FROM (SELECT {BENCH_NORM} AS n FROM benchmark), (VALUES ('a', 'e'), ('b', 't')) AS g(engine, e) GROUP BY 1""")
def cer_by_engine(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    runs = b.select(F.lit("a").alias("engine"), F.translate(X.normalize(F.col("text")), "e", "x").alias("h"), "text").unionByName(
        b.select(F.lit("b").alias("engine"), F.translate(X.normalize(F.col("text")), "t", "x").alias("h"), "text")
    )
    return stats.benchmark_means(runs.withColumn("cer", stats.character_error_rate(F.col("h"), F.col("text"))), ["engine"], ["cer"])


@query(rf"""SELECT engine, round(avg(CASE engine WHEN 'court' THEN 1.0 WHEN 'long' THEN 2.0 ELSE 0.0 END / n), 4) AS wer, count(*) AS runs
    FROM (SELECT len(list_filter(string_split({BENCH_NORM}, ' '), lambda x: x <> '')) AS n FROM benchmark), (VALUES ('court'), ('long'), ('exact')) AS g(engine) WHERE n > 0 GROUP BY 1""")
def wer_by_engine(spark, sf_dir):
    """Readings with the last word lost, with two words more, and as they are."""
    words = F.filter(F.split(X.normalize(F.col("text")), " "), lambda w: w != "")
    b = table(spark, sf_dir, "benchmark").withColumn("w", words).where(F.size("w") > 0)
    read = {"court": F.slice("w", F.lit(1), F.size("w") - 1), "long": F.concat(F.col("w"), F.array(F.lit("zzqx"), F.lit("zzqy"))), "exact": F.col("w")}
    runs = [b.select(F.lit(k).alias("engine"), stats.word_error_rate(F.array_join(h, " "), F.col("text")).alias("wer")) for k, h in read.items()]
    return stats.benchmark_means(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["engine"], ["wer"])


@query("SELECT min_by(l_linenumber, (v, l_linenumber)) AS l_linenumber, min(v) AS v FROM (SELECT l_linenumber, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1)")
def min_by_best(spark, sf_dir):
    return stats.best_by(stats.benchmark_means(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity")), ["l_linenumber"], ["v"]), "l_linenumber", "v")


@query("""SELECT user_id, round(sum(value * event_id) / sum(event_id), 6) AS score FROM events GROUP BY 1 HAVING sum(event_id) > 0""")
def weighted_scores(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("score"), F.col("event_id").cast("double").alias("weight"))).alias("p"))
    return g.select("user_id", F.round(stats.weighted_mean(F.col("p")), 6).alias("score")).where("score is not null")


# --- audit, store -----------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.lit("u").alias("actor"),
        F.col("event_type").alias("event"), F.col("props").alias("payload"),
    )


CHAIN_SQL = """SELECT CAST(user_id AS VARCHAR) AS log, list_reduce(list_prepend('GENESIS', list(epoch_us(CAST(ts AS TIMESTAMP)) || '|u|' || event_type || '|' || props ORDER BY event_id)),
    lambda a, b: sha256(a || '|' || b)) AS last_hash FROM events GROUP BY 1"""


@query(CHAIN_SQL)
def chain_append(spark, sf_dir):
    c = audit.chain(_log(spark, sf_dir))
    return c.groupBy("log").agg(F.max_by("entry_hash", "id").alias("last_hash"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS log, true AS valid FROM events")
def chain_verify(spark, sf_dir):
    return audit.verify(audit.chain(_log(spark, sf_dir)))


@query("SELECT CAST(user_id AS VARCHAR) AS log, min(event_id) % 2 = 0 AS valid FROM events GROUP BY 1")
def chain_tamper(spark, sf_dir):
    """A changed payload in the first entry of every second log is noticed."""
    c = audit.chain(_log(spark, sf_dir))
    first = F.min("id").over(Window.partitionBy("log"))
    return audit.verify(c.withColumn("payload", F.when((first == F.col("id")) & (first % 2 == 1), F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
    f AS (SELECT user_id, k, t, CAST(NOT ok AS INT) AS n, CAST(0 AS BIGINT) AS until, false AS locks FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN f.until > e.t THEN f.n WHEN e.ok THEN 0 ELSE f.n + 1 END,
            CASE WHEN f.until > e.t THEN f.until WHEN e.ok OR f.n < 4 THEN 0 ELSE e.t + 900000000 END, f.until <= e.t AND NOT e.ok AND f.n >= 4
        FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, t AS locked_at, until AS locked_until FROM f WHERE locks""")
def lockout_windows(spark, sf_dir):
    a = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "purchase")
    return audit.failure_runs(a).select("user_id", F.unix_micros(F.col("locked_at").cast("timestamp")).alias("locked_at"), F.unix_micros(F.col("locked_until").cast("timestamp")).alias("locked_until"))


@query("""WITH g AS (SELECT user_id, ts, CAST(ts AS TIMESTAMP) >= lag(CAST(ts AS TIMESTAMP)) OVER w + INTERVAL 600 MINUTE AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(CAST(coalesce(gap, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, epoch_us(CAST(min(ts) AS TIMESTAMP)) AS start, epoch_us(CAST(max(ts) AS TIMESTAMP)) AS "end", count(*) AS n FROM s GROUP BY user_id, s.n""")
def session_gaps(spark, sf_dir):
    s = audit.sessions(table(spark, sf_dir, "events"), minutes=600)
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("end").cast("timestamp")).alias("end"), "n")


@query("""SELECT user_id, event_id, coalesce(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 15 AS open FROM events""")
def breaker_open(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    return audit.breaker_open(e, key="user_id", order="event_id").select("user_id", "event_id", "open")


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(event_id % 4 AS VARCHAR) AS job_id, event_id, event_type IN ('signup', 'click', 'view') AS starts, row_number() OVER (PARTITION BY user_id ORDER BY event_id, CAST(event_id % 4 AS VARCHAR)) AS k FROM events),
    f AS (SELECT user_id, k, event_id, CASE WHEN starts THEN job_id ELSE '' END AS running, starts AS accepte FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.starts AND f.running = '' THEN e.job_id WHEN NOT e.starts AND f.running = e.job_id THEN '' ELSE f.running END,
            CASE WHEN e.starts THEN f.running IN ('', e.job_id) ELSE f.running = e.job_id END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id, accepte FROM f""")
def one_active_job(spark, sf_dir):
    """Events as jobs of a user's document: what starts while another runs is refused."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("signup", "click", "view"), "processing").otherwise("done")
    jobs = e.select("user_id", (F.col("event_id") % 4).cast("string").alias("job_id"), F.col("event_id").alias("ts"), status.alias("status"))
    return audit.job_verdicts(jobs, key="user_id").select("user_id", F.col("ts").alias("event_id"), "accepte")


@query("""WITH m AS (SELECT CAST(l_linenumber AS VARCHAR) AS engine, l_returnflag = 'N' AS preprocessing, round(avg(CAST(l_discount AS DOUBLE)), 4) AS cer, round(avg(CAST(l_tax AS DOUBLE)), 4) AS wer,
        round(avg(CAST(l_quantity AS DOUBLE)), 4) AS time_sec, count(*) AS runs FROM lineitem GROUP BY 1, 2)
    SELECT m.*, round(1 - m.cer / o.cer, 4) AS gain FROM m LEFT JOIN m o ON o.engine = m.engine AND o.preprocessing <> m.preprocessing AND o.cer > 0""")
def benchmark_gain(spark, sf_dir):
    """Means by engine and setting, and by how much each setting beats the other."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("engine"), (F.col("l_returnflag") == "N").alias("preprocessing"), F.col("l_discount").cast("double").alias("cer"),
        F.col("l_tax").cast("double").alias("wer"), F.col("l_quantity").cast("double").alias("time_sec"),
    )
    return stats.benchmark_report(rows)


@query("SELECT conv_id AS document_id, CAST(floor(turn / 20) AS INT) AS lot, count(*) AS pages FROM conversations GROUP BY 1, 2")
def page_batches(spark, sf_dir):
    """Pages in batches of twenty, each to be read apart."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"))
    return files.page_batches(c).groupBy("document_id", "lot").agg(F.count(F.lit(1)).alias("pages"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(string_split_regex(url, '[/\\]')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '^\.+', ''), ''), 'document') AS nom FROM pages""")
def safe_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.safe_name(F.col("url")).alias("nom"))


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, CASE event_type WHEN 'click' THEN 'pathologies_actives' WHEN 'purchase' THEN 'traitements_long_cours' WHEN 'signup' THEN 'points_vigilance' END AS section, n
    FROM f WHERE event_type IN ('click', 'purchase', 'signup')""")
def complement_sections(spark, sf_dir):
    """Entities of a complement model by section; labels it is not asked for go."""
    names = F.create_map(*(F.lit(x) for kv in (("click", "Disease"), ("purchase", "CW"), ("signup", "Symptom"), ("view", "PER")) for x in kv))
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("?")).alias("label"), F.lit("x").alias("texte"), F.lit(0).alias("debut"), F.lit(1).alias("fin"), F.col("value").alias("score")
    )
    return entities.complement_fields(e).groupBy(F.col("document_id").alias("user_id"), "section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def latest_entries(spark, sf_dir):
    return audit.latest(table(spark, sf_dir, "orders"), "o_orderkey", 10)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'X' FROM orders WHERE o_orderkey % 7 = 0""")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("v"))
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(
        o.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(1).alias("v"))
    )
    return store.upsert(o, new, ["o_orderkey"], "v").select("o_orderkey", "o_orderstatus")


@query("""SELECT 'orders' AS "table", count(*) AS removed FROM orders WHERE o_custkey % 10 = 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 = 0""")
def cascade_delete(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "dossier_id")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "dossier_id")
    _, removed = store.forget({"orders": o, "customer": c}, c.where("dossier_id % 10 = 0"))
    return removed


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 <> 0")
def forgotten_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kept, _ = store.forget({"o": o}, table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey")), key="o_custkey")
    return kept["o"].select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT conv_id, turn, sha256(text) AS relu, false AS en_clair FROM conversations WHERE text IS NOT NULL")
def encrypted_fields(spark, sf_dir):
    """Every text as it is read back, and whether it was stored as it is."""
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumn("k", F.concat_ws("/", "conv_id", "turn"))
    c = c.withColumn("enc", store.encrypt(F.col("text"), key, "conversations", F.col("k")))
    back = store.decrypt(F.col("enc"), key, "conversations", F.col("k"))
    return c.select("conv_id", "turn", F.sha2(F.encode(back, "UTF-8"), 256).alias("relu"), F.contains(F.hex("enc"), F.hex(F.encode("text", "UTF-8"))).alias("en_clair"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'machinery')""")
def search_palette(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("document_id"), F.col("c_mktsegment").alias("statut"), "c_custkey", "c_acctbal")
    return assemble.search(c, "MACHINERY").select("c_custkey", F.col("document_id").alias("c_name"), "c_acctbal")


def _re2(rx: str) -> str:
    """A pattern of this library in the SQL side's dialect."""
    return rx.replace("(?iuU)", "(?i)").replace("'", "''")


@query(rf"""SELECT doc_id, length(trim(text, ' ')) >= 40 AND n >= 1 AND (NOT regexp_matches(text, '{_re2(segments.ADMINISTRATIVE)}') OR n >= 2) AS pertinent
    FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{_re2(segments.CLINICAL)}')) AS n FROM documents)""")
def segment_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segments.is_relevant(F.col("text")).alias("pertinent"))


@query()
def segment_chunks(spark, sf_dir):
    s = segments.segments(F.col("text"), overlap=segments.OVERLAP)
    return table(spark, sf_dir, "documents").select("doc_id", spans.let(s, lambda x: F.struct(F.size(x).alias("n"), F.array_max(F.transform(x, F.length)).alias("longest"))).alias("s")).select("doc_id", "s.*")


NAMED = "Patient [PATIENT_001] puis [PATIENT_002], né le [DATE_NAISSANCE_001]\nsexe : M, dossier {}, vu par [RPPS_001]"


@query("""SELECT doc_id, '[PATIENT_001]' AS identite, '[DATE_NAISSANCE_001]' AS date_naissance, CAST(NULL AS VARCHAR) AS ins, '[RPPS_001]' AS rpps, CAST(NULL AS VARCHAR) AS adeli, 'H' AS sexe FROM documents""")
def identity_fields(spark, sf_dir):
    """The first pseudonym of each kind in a report of each document's own."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), _filled(NAMED).alias("text"))
    i = assemble.identity(d)
    return i.select(F.col("document_id").cast("long").alias("doc_id"), "identite", "date_naissance", "ins", "rpps", "adeli", "sexe")


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) UNION ALL SELECT -1, o_custkey FROM orders")
def augment_missing(spark, sf_dir):
    """All orders and the customers without any."""
    base = table(spark, sf_dir, "orders").select(F.lit(-1).alias("c_nationkey"), F.col("o_custkey").alias("c_custkey"))
    return entities.augment(base, table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), keys=("c_custkey",))
