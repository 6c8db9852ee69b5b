"""One query for each operator, over the test tables, with the SQL that gives the same rows.

Signals that the tables lack are derived from them by rule (``SIGNALS``); the rules are written once, in SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import provider as P
from verdigris.functions.text import sentence
from verdigris.operators import accuracy, hamming, ocr
from verdigris.operators import validate as V
from verdigris.operators.decision import best_score, decide, image_match, investment_signal, politics_signal
from verdigris.operators.dictionary import Term, banned_violation, banned_violation_by_join, has_political_term
from verdigris.operators.username import local_violation, username_violation
from verdigris.session import shared_folder
from verdigris.sources import dictionaries as D
from verdigris.sources import hashes as H

from . import moderation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Signals

#: Column -> SQL over documents d left-joined to labels l.
SIGNALS = {
    "content_type": "CASE d.doc_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'COMMENT' ELSE 'USERNAME' END",
    "local_violation": "CASE WHEN d.doc_id % 29 = 0 THEN 'VULGAR' WHEN d.doc_id % 31 = 0 THEN 'HARASSMENT' ELSE 'NONE' END",
    "moderation_status": "CASE WHEN l.doc_id IS NULL THEN 'error' ELSE 'ok' END",
    "flagged": "l.toxic = 1",
    "classification_status": "CASE WHEN d.doc_id % 17 = 3 THEN 'error' WHEN d.doc_id % 41 = 0 THEN NULL ELSE 'ok' END",
    "action": "CASE d.doc_id % 7 WHEN 0 THEN 'block' WHEN 1 THEN 'unknown' WHEN 2 THEN 'junk' WHEN 3 THEN NULL ELSE 'allow' END",
    "category": "CASE d.doc_id % 11 WHEN 0 THEN 'hate' WHEN 1 THEN 'Self-Harm' WHEN 2 THEN 'nonsense' WHEN 3 THEN NULL ELSE 'none' END",
    "investment": "CASE d.doc_id % 5 WHEN 0 THEN 'not_related' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'NOT_RELATED' ELSE 'related' END",
    "politics": "CASE d.doc_id % 4 WHEN 0 THEN 'not_related' WHEN 1 THEN ' High_Risk ' WHEN 2 THEN 'odd' ELSE NULL END",
    "matched": "CASE WHEN d.doc_id % 23 = 0 THEN d.doc_id % 2 = 0 END",
    "quality_accepted": "CASE WHEN d.doc_id % 23 = 0 THEN d.doc_id % 3 <> 0 END",
    "media_status": "CASE WHEN d.doc_id % 37 = 0 THEN 'error' WHEN d.doc_id % 23 = 0 THEN 'ok' END",
}
#: Entries in a provider's order: key -> SQL of the value.
FLAGS = {"hate/threatening": "d.doc_id % 2 = 0", "sexual-minors": "d.doc_id % 3 = 0", "spam_scam": "d.doc_id % 5 = 0", "brand new": "d.doc_id % 7 = 0"}
SCORES = {"violence": "(d.doc_id % 8) / 10.0", "sexual/minors": "(d.doc_id % 5) / 10.0", "harassment": "CASE WHEN d.doc_id % 6 = 0 THEN 0.7 ELSE 0.1 END", "illicit/violent": "(d.doc_id % 8) / 10.0"}

SOURCE = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its signals; flags and scores are arrays of (key, value)."""
    d, l = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")  # noqa: E741
    entries = lambda rules, kind: F.array(*(F.struct(F.lit(k).alias("key"), F.expr(x).cast(kind).alias("value")) for k, x in rules.items()))
    return d.join(l, F.expr("d.doc_id = l.doc_id"), "left").select("d.doc_id", *(F.expr(x).alias(k) for k, x in SIGNALS.items()), entries(FLAGS, "boolean").alias("flags"), entries(SCORES, "double").alias("scores"))


#: What the SQL expects of labels; written out, so that a fault in the engine's own table shows.
EXPECTED_VIOLATIONS = """
NONE: |none|null
HARASSMENT: harassment
HATE: hate|hate/threatening
THREAT: threat|harassment/threatening
SELF_HARM: self_harm|self_harm/intent|self_harm/instructions
SEXUAL: sexual
SEXUAL_MINORS: sexual_minors|sexual/minors
GRAPHIC_VIOLENCE: graphic_violence|violence/graphic
VIOLENCE: violence
ILLICIT: illicit|illicit/violent
SPAM_SCAM: spam_scam
VULGAR: vulgar
IMPERSONATION: impersonation|reserved_username
"""
EXPECTED = [(label, violation) for violation, _, labels in (x.partition(": ") for x in EXPECTED_VIOLATIONS.strip().split("\n")) for label in labels.split("|")]


def violation_sql(x: str) -> str:
    """The violation of a label, as SQL."""
    cases = " ".join(f"WHEN '{label}' THEN '{violation}'" for label, violation in EXPECTED)
    return f"CASE replace(lower(trim(coalesce({x}, 'null'))), '-', '_') {cases} ELSE 'OTHER' END"


TOP = f"greatest({', '.join(f'CAST({x} AS DOUBLE)' for x in SCORES.values())})"
SIGNALS_SQL = f"""
s AS (SELECT d.doc_id, {", ".join(f"{x} AS {k}" for k, x in SIGNALS.items())},
  CASE {" ".join(f"WHEN {x} THEN '{k}'" for k, x in FLAGS.items())} END AS first_flag,
  {TOP} AS top_value, CASE {" ".join(f"WHEN CAST({x} AS DOUBLE) = {TOP} THEN '{k}'" for k, x in SCORES.items())} END AS top_key
  FROM {SOURCE}),
v AS (SELECT *, CASE WHEN first_flag IS NULL THEN 'OTHER' ELSE {violation_sql("first_flag")} END AS flag_violation, {violation_sql("category")} AS mapped, {violation_sql("top_key")} AS top_violation FROM s),
r AS (SELECT *, CASE
  WHEN coalesce(matched, false) THEN 'BLOCK KNOWN_IMAGE'
  WHEN moderation_status = 'ok' AND coalesce(flagged, false) THEN 'BLOCK ' || flag_violation
  WHEN content_type <> 'POST' AND local_violation <> 'NONE' THEN 'BLOCK ' || local_violation
  WHEN content_type = 'POST' AND classification_status = 'ok' AND investment = 'not_related' THEN 'BLOCK NOT_INVESTMENT'
  WHEN coalesce(moderation_status, '') <> 'ok' OR coalesce(classification_status, '') <> 'ok' OR coalesce(media_status, '') = 'error' THEN 'UNKNOWN ANALYZER_ERROR'
  WHEN action = 'block' THEN 'BLOCK ' || replace(mapped, 'NONE', 'OTHER')
  WHEN action = 'unknown' THEN 'UNKNOWN ' || replace(mapped, 'NONE', 'OTHER')
  WHEN coalesce(action, '') <> 'allow' THEN 'UNKNOWN ANALYZER_ERROR'
  WHEN mapped <> 'NONE' THEN 'UNKNOWN ' || mapped
  WHEN top_value >= 0.7 THEN 'UNKNOWN ' || top_violation
  WHEN content_type = 'POST' AND coalesce(investment, '') <> 'related' THEN 'UNKNOWN NOT_INVESTMENT'
  ELSE 'ALLOW NONE' END AS result FROM v)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    result = decide(c("content_type"), c("local_violation"), c("moderation_status"), c("flagged"), c("flags"), c("scores"), c("classification_status"), c("action"), c("category"), c("investment"), c("matched"), c("media_status"))
    return signals(spark, sf_dir).withColumn("result", result)


@query(f"WITH {SIGNALS_SQL} SELECT doc_id, split_part(result, ' ', 1) AS decision, split_part(result, ' ', 2) AS violation FROM r")
def decision_policy(spark, sf_dir):
    return decided(spark, sf_dir).select("doc_id", "result.decision", "result.violation")


@query(f"WITH {SIGNALS_SQL} SELECT split_part(result, ' ', 1) AS decision, split_part(result, ' ', 2) AS violation, content_type, count(*) AS n FROM r GROUP BY ALL")
def decision_counts(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("result.decision", "result.violation", "content_type").agg(F.count("*").alias("n"))


ODD_LABELS = [(" Hate ", "HATE"), ("SELF-HARM", "SELF_HARM"), ("Self-Harm/Intent", "SELF_HARM"), ("unheard of", "OTHER"), ("sexual-minors", "SEXUAL_MINORS"), (None, "NONE")]
VALUES = ", ".join(f"({i}, {'NULL' if x is None else repr(x)}, '{v}')" for i, (x, v) in enumerate([*EXPECTED, *ODD_LABELS]))


@query(f"SELECT * FROM (VALUES {VALUES}) t(n, label, violation)")
def violation_from_provider(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, (x, _) in enumerate([*EXPECTED, *ODD_LABELS])], "n int, label string").withColumn("violation", P.violation_of(F.col("label")))


@query(f"WITH {SIGNALS_SQL} SELECT doc_id, flag_violation AS violation FROM r")
def flagged_category_first(spark, sf_dir):
    return signals(spark, sf_dir).select("doc_id", P.first_flagged(F.col("flags")).alias("violation"))


@query(f"WITH {SIGNALS_SQL} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'hate' ELSE top_key END AS key, CASE WHEN doc_id % 9 = 0 THEN 0.25 ELSE top_value END AS value FROM r")
def top_score(spark, sf_dir):
    """Ties go to the first; where the first map has no scores, the second is used."""
    other = F.array(F.struct(F.lit("hate").alias("key"), F.lit(0.25).alias("value")))
    first = F.when(F.col("doc_id") % 9 != 0, F.col("scores")).otherwise(F.transform("scores", lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast("double").alias("value"))))
    return signals(spark, sf_dir).select("doc_id", best_score(first, other).alias("x")).select("doc_id", "x.key", "x.value")


# Dictionaries

#: An IMPERSONATION term comes first, so it hides later terms of a text that has both.
DEMO = ["IMPERSONATION|Loser", "HARASSMENT|idiot", "HARASSMENT|m0ron", "VULGAR|scum", "HARASSMENT|clown", "VULGAR|trash", "HATE|disgusting", "HARASSMENT|pathetic", "VULGAR|the stupid", "HARASSMENT|worthless"]


#: What those lines come to.
EXPECTED_TERMS = [(3, "IMPERSONATION", "loser"), (4, "HARASSMENT", "idiot"), (5, "HARASSMENT", "moron"), (6, "VULGAR", "scum"), (7, "HARASSMENT", "clown"), (8, "VULGAR", "trash"), (9, "HATE", "disgusting"), (10, "HARASSMENT", "pathetic"), (11, "VULGAR", "the stupid"), (12, "HARASSMENT", "worthless")]


def demo_terms() -> list[Term]:
    return D.parse_banned(["# demo", "", *DEMO])


def edge(words: str) -> str:
    """Whole words, for an engine without lookaround."""
    return rf"(^|[^\p{{L}}\p{{N}}])(?:{words})($|[^\p{{L}}\p{{N}}])"


NORMAL = "translate(lower({}), '013457@$', 'oieastas')"
JOINED = r"regexp_replace(regexp_replace({0}, '(\p{{L}})[\p{{P}}_]+(\p{{L}})', '\1\2', 'g'), '(\p{{L}})[\p{{P}}_]+(\p{{L}})', '\1\2', 'g')"


def banned_sql(x: str) -> str:
    terms = [(v, r"[\p{Z}\p{P}_]+".join(t.split())) for _, v, t in EXPECTED_TERMS]
    first = lambda y: "CASE " + " ".join(f"WHEN regexp_matches({y}, '{edge(w)}') THEN '{v}'" for v, w in terms) + " ELSE 'NONE' END"
    normal = NORMAL.format(x)
    return f"CASE WHEN {first(normal)} <> 'NONE' THEN {first(normal)} ELSE {first(JOINED.format(normal))} END"


@query(f"SELECT doc_id, {banned_sql('text')} AS violation FROM documents")
def banned_term_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", banned_violation(F.col("text"), demo_terms()).alias("violation"))


@query(f"SELECT doc_id, {banned_sql('text')} AS violation FROM documents")
def banned_term_join(spark, sf_dir):
    """The same first match, in both passes, for dictionaries that are tables."""
    return banned_violation_by_join(table(spark, sf_dir, "documents"), D.as_table(spark, demo_terms()), "doc_id", "text")


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{v}', '{t}')" for n, v, t in EXPECTED_TERMS) + ") t(ord, violation, term)")
def dictionary_load(spark, sf_dir):
    return D.as_table(spark, demo_terms())


#: Endings put to texts, and whether they name a political topic: terms of all four languages, in odd spellings, and words that only resemble them.
ENDINGS = [(" Governm3nt", True), (" governments", False), (" millət_vəkili!", True), (" MECLIS", True), (" meclisi", False), (" совет  федерации", True), (" советфедерации", False), (" cumhurbaşkanı.", True), (" Президент", True), (" votes", False), (" ruling-party", True), (" party ruling", False), (" 3lecti0n", True), ("", False)]
ENDING_SQL = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(ENDINGS))) + " END"


# The tables' own words name no political topic.
@query("SELECT doc_id, " + ENDING_SQL.format(*(str(x).lower() for _, x in ENDINGS)) + " AS political FROM documents")
def political_flag(spark, sf_dir):
    text = F.concat("text", F.expr(ENDING_SQL.format(*(repr(x) for x, _ in ENDINGS))))
    return table(spark, sf_dir, "documents").select("doc_id", has_political_term(text, D.political_terms()).alias("political"))


@query(f"SELECT doc_id, CASE WHEN v = 'IMPERSONATION' THEN 'NONE' ELSE v END AS violation FROM (SELECT doc_id, {banned_sql('text')} AS v FROM documents)")
def comment_local_violation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", local_violation(F.lit("COMMENT"), F.col("text"), demo_terms()).alias("violation"))


NAMES = {
    "IMPERSONATION": "admin moderator notrealadmin adm1n a​dmin ａｄｍｉｎ m0derat0r аdmin super-admin admin123 админ модератор moderatör platforma_admini platform_yöneticisi Official_Support rəsmi_dəstək официальная_поддержка служба_поддержки".split(),
    "HARASSMENT": ["IdiotFan", "big_m0ron"],
    "VULGAR": ["ScumUser"],
    "NONE": ["", "BadmintonFan", "AdministrativeLaw", "AdministeringCare", "ModernArtist", "ModularSynth", "SupportUkraine", "SupporterAli", "OfficialMusicFan", "OfficiallyBookish", "StaffordReader", "DəstəkçiAysel", "DestekleyiciDeniz", "YönetimBilimi", "АдминистративноеПраво", "ПоддерживаюАнну"],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for v, names in NAMES.items() for n in names) + ") t(username, violation)")
def username_policy(spark, sf_dir):
    names = spark.createDataFrame([(n,) for names in NAMES.values() for n in names], "username string")
    return names.select("username", username_violation(F.col("username"), demo_terms()).alias("violation"))


# Validation

RAW = {
    "content_id": "CASE WHEN doc_id % 19 = 0 THEN '  ' WHEN doc_id % 43 = 0 THEN repeat('x', 129) ELSE 'c' || doc_id END",
    "content_type": "CASE doc_id % 6 WHEN 0 THEN ' post' WHEN 1 THEN 'Comment ' WHEN 2 THEN 'USERNAME' WHEN 3 THEN 'article' WHEN 4 THEN 'POST' ELSE '' END",
    "shown": "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 8 = 0 THEN '   ' ELSE text END",
    "image_bytes": "CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN n_chars * 4000 END",
    "mime": "CASE doc_id % 3 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'text/plain' END",
}
RAW_SQL = f"q AS (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in RAW.items())} FROM documents), k AS (SELECT *, CASE WHEN upper(trim(content_type)) IN ('POST', 'COMMENT', 'USERNAME') THEN upper(trim(content_type)) END AS kind FROM q)"


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(F.expr(x).alias(k) for k, x in RAW.items()))


@query(
    f"""WITH {RAW_SQL}, f AS (SELECT doc_id, kind, CASE
  WHEN trim(content_id) = '' THEN 'contentId must not be blank'
  WHEN length(content_id) > 128 THEN 'contentId size must be between 0 and 128'
  WHEN trim(content_type) = '' THEN 'contentType must not be blank'
  WHEN length(shown) > 20000 THEN 'text size must be between 0 and 20000'
  WHEN kind IS NULL THEN 'contentType must be POST, COMMENT, or USERNAME'
  WHEN kind <> 'POST' AND image_bytes IS NOT NULL THEN 'images are accepted only for POST'
  WHEN image_bytes = 0 THEN 'empty image'
  WHEN trim(shown) = '' AND image_bytes IS NULL THEN 'text or image is required' END AS reason FROM k)
SELECT doc_id, 400 AS http_status, 'INVALID_INPUT' AS error_code, reason || '.' AS message FROM f WHERE reason IS NOT NULL"""
)
def validation_rejects(spark, sf_dir):
    fault = V.request_fault(F.col("content_id"), F.col("content_type"), F.col("shown"), F.col("image_bytes"))
    return V.split_by_fault(raw_requests(spark, sf_dir), fault, "doc_id")[1]


@query(
    f"""WITH {RAW_SQL}, a AS (SELECT doc_id,
  CASE WHEN image_bytes > 10485760 THEN 413 WHEN image_bytes IS NOT NULL AND lower(coalesce(mime, '')) NOT IN ('image/jpeg', 'image/png', 'image/gif') THEN 415 END AS request_status,
  CASE WHEN kind <> 'POST' THEN 400 WHEN lower(coalesce(mime, '')) NOT IN ('image/jpeg', 'image/png', 'image/gif') THEN 415 WHEN image_bytes = 0 THEN 400 WHEN image_bytes > 10485760 THEN 413 END AS analysis_status,
  CASE WHEN image_bytes = 0 THEN 400 WHEN image_bytes > 10485760 THEN 413 WHEN doc_id % 2 = 0 THEN 422 END AS media_status FROM k)
SELECT * FROM a"""
)
def image_gates(spark, sf_dir):
    size, mime, kind = F.col("image_bytes"), F.col("mime"), V.parsed_type(F.col("content_type"))
    return raw_requests(spark, sf_dir).select("doc_id", V.image_fault(size, mime)["status"].alias("request_status"), V.analysis_image_fault(kind, size, mime)["status"].alias("analysis_status"), V.media_image_fault(size, F.col("doc_id") % 2 != 0)["status"].alias("media_status"))


#: kind, explicit status, reason; then what they come to: status, code, message.
FAILURES = [
    (None, 400, None, 400, "INVALID_INPUT", "Request is invalid."),
    (None, 404, None, 404, "NOT_FOUND", "Endpoint not found."),
    (None, 405, None, 405, "METHOD_NOT_ALLOWED", "HTTP method is not supported."),
    (None, 406, None, 406, "NOT_ACCEPTABLE", "Requested response type is not supported."),
    (None, 409, None, 409, "INVALID_INPUT", "Request is invalid."),
    (None, 413, None, 413, "PAYLOAD_TOO_LARGE", "Image exceeds the size limit."),
    (None, 415, None, 415, "UNSUPPORTED_MEDIA_TYPE", "Media type is not supported."),
    (None, 422, None, 422, "UNPROCESSABLE_IMAGE", "Image could not be processed."),
    (None, 500, None, 500, "INTERNAL_ERROR", "Internal server error."),
    (None, 502, None, 502, "INTERNAL_ERROR", "Internal server error."),
    (None, 503, None, 503, "SERVICE_UNAVAILABLE", "Service is not available."),
    (None, 400, " bad thing ", 400, "INVALID_INPUT", "bad thing."),
    (None, 422, "really?", 422, "UNPROCESSABLE_IMAGE", "really?"),
    (None, 503, "secret", 503, "SERVICE_UNAVAILABLE", "Service is not available."),
    ("upload_too_large", None, None, 413, "PAYLOAD_TOO_LARGE", "Image exceeds the size limit."),
    ("media_type", None, None, 415, "UNSUPPORTED_MEDIA_TYPE", "Media type is not supported."),
    ("missing_parameter", None, None, 400, "INVALID_INPUT", "Request is invalid."),
    ("validation", None, None, 400, "INVALID_INPUT", "Request is invalid."),
    ("multipart", None, None, 400, "INVALID_INPUT", "Request is invalid."),
    ("other", None, None, 500, "INTERNAL_ERROR", "Internal server error."),
]
FAILURE_VALUES = ", ".join(f"({i}, {s}, '{c}', '{m}')" for i, (_, _, _, s, c, m) in enumerate(FAILURES))


@query(f"SELECT * FROM (VALUES {FAILURE_VALUES}) t(n, status, error_code, message)")
def error_mapping(spark, sf_dir):
    rows = spark.createDataFrame([(i, *f[:3]) for i, f in enumerate(FAILURES)], "n int, kind string, explicit int, reason string").withColumn("status", V.status_of(F.col("kind"), F.col("explicit")))
    return rows.select("n", "status", V.error_code(F.col("status")).alias("error_code"), V.error_message(F.col("status"), F.col("reason")).alias("message"))


@query("SELECT doc_id, CASE WHEN regexp_matches(trim(t), '[.!?]$') THEN trim(t) ELSE trim(t) || '.' END AS message FROM (SELECT doc_id, ' ' || source || CASE doc_id % 3 WHEN 0 THEN '! ' WHEN 1 THEN ' ' ELSE '.' END AS t FROM documents)")
def sentences(spark, sf_dir):
    text = F.concat(F.lit(" "), "source", F.when(F.col("doc_id") % 3 == 0, "! ").when(F.col("doc_id") % 3 == 1, " ").otherwise("."))
    return table(spark, sf_dir, "documents").select("doc_id", sentence(text).alias("message"))


# Hashes: a text's SHA-256 stands for an image's hash. Those of toxic documents are blocked, with their first digits replaced, which puts distances on both sides of the threshold.

BLOCKED_SQL = "b AS (SELECT DISTINCT CASE WHEN d.doc_id % 4 = 0 THEN sha256(text) WHEN d.doc_id % 2 = 0 THEN repeat('0', 8) || substr(sha256(text), 9) ELSE repeat('0', 15) || substr(sha256(text), 16) END AS hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1)"
WORDS_SQL = "[{}]".format(", ".join(f"('0x' || substr(hash, {16 * k + 1}, 16))::ubigint" for k in range(4)))
DISTANCE_SQL = " + ".join(f"bit_count(xor(h.w[{k}], b.w[{k}]))::INT" for k in range(1, 5))
NEAREST_SQL = f"h AS (SELECT doc_id, quality, hash, {WORDS_SQL} AS w FROM (SELECT doc_id, sha256(text) AS hash, n_chars % 101 AS quality FROM documents)), {BLOCKED_SQL}, bw AS (SELECT hash, {WORDS_SQL} AS w FROM b)"


def hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), (F.col("n_chars") % 101).cast("int").alias("quality"))


def blocked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    h = F.col("hash")
    changed = F.when(F.col("doc_id") % 4 == 0, h).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("0" * 8), F.substring(h, 9, 64))).otherwise(F.concat(F.lit("0" * 15), F.substring(h, 16, 64)))
    return hash_table(spark, sf_dir).join(toxic, "doc_id").select(changed.alias("hash")).distinct()  # hashes before the join, so that it moves no texts


def nearest_sql(threshold: int) -> str:
    return f"WITH {NEAREST_SQL} SELECT doc_id, min({DISTANCE_SQL.replace('b.w', 'bw.w')}) AS distance FROM h, bw GROUP BY doc_id HAVING min({DISTANCE_SQL.replace('b.w', 'bw.w')}) <= {threshold}"


@query(nearest_sql(31))
def hamming_nearest(spark, sf_dir):
    return hamming.nearest(hash_table(spark, sf_dir), blocked_table(spark, sf_dir), 31, "doc_id")


@query(nearest_sql(15))
def hamming_nearest_15(spark, sf_dir):
    return hamming.nearest(hash_table(spark, sf_dir), blocked_table(spark, sf_dir), 15, "doc_id")


@query(nearest_sql(90))
def hamming_full_scan(spark, sf_dir):
    return hamming.nearest(hash_table(spark, sf_dir), blocked_table(spark, sf_dir), 90, "doc_id")


@query(
    f"""WITH {NEAREST_SQL}, n AS (SELECT doc_id, min({DISTANCE_SQL.replace('b.w', 'bw.w')}) AS distance FROM h, bw WHERE quality > 49 GROUP BY doc_id)
SELECT h.doc_id, hash, quality, quality > 49 AS quality_accepted, quality > 49 AND (SELECT count(*) > 0 FROM b) AS has_comparison, coalesce(distance <= 31, false) AS matched, CASE WHEN distance <= 31 THEN distance ELSE -1 END AS distance FROM h LEFT JOIN n ON h.doc_id = n.doc_id"""
)
def pdq_match_signal(spark, sf_dir):
    return hamming.match_signal(hash_table(spark, sf_dir), blocked_table(spark, sf_dir), key="doc_id")


@query(f"WITH {NEAREST_SQL} SELECT doc_id, bit_count(w[1])::INT + bit_count(w[2])::INT + bit_count(w[3])::INT + bit_count(w[4])::INT AS norm, bit_count(xor(w[1], w[2])) AS ends, hash FROM h")
def hash_operations(spark, sf_dir):
    """Parsing, norm, exclusive-or and printing of hashes."""
    w = hamming.words(F.col("hash"))
    rows = hash_table(spark, sf_dir).withColumn("w", w)
    twice = hamming.bitwise("not", hamming.bitwise("not", F.col("w")))
    return rows.select("doc_id", hamming.norm(F.col("w")).alias("norm"), F.bit_count(F.get("w", F.lit(0)).bitwiseXOR(F.get("w", F.lit(1)))).alias("ends"), hamming.hexed(twice).alias("hash"))


WORD_SQL = ["('0x' || substr(hash, {}, 4))::INT".format(4 * k + 1) for k in range(16)]


@query(
    f"""WITH {NEAREST_SQL} SELECT doc_id, concat_ws(' ', {", ".join(f"substr(hash, {4 * k + 1}, 4)" for k in range(16))}) AS words, concat_ws(' ', {", ".join(f"('0x' || substr(hash, {16 * k + 1}, 16))::ubigint::hugeint - CASE WHEN hash[{16 * k + 1}] >= '8' THEN 18446744073709551616 ELSE 0 END" for k in range(4))}) AS longs,
  concat_ws(',', {", ".join(f"{x} - CASE WHEN {x} >= 32768 THEN 65536 ELSE 0 END" for x in reversed(WORD_SQL))}) AS order_key FROM h"""
)
def hash_forms(spark, sf_dir):
    """Hashes as words and numbers, and what orders them."""
    w = hamming.words(F.col("hash"))
    return hash_table(spark, sf_dir).select("doc_id", hamming.printed(w, "words").alias("words"), hamming.printed(w, "longs").alias("longs"), F.array_join(F.transform(hamming.order_key(w), lambda x: x.cast("string")), ",").alias("order_key"))


OBSERVED_SQL = "o AS (SELECT source AS content_id, sha256(text) AS hash, n_chars % 101 AS quality, doc_id FROM documents UNION ALL SELECT source, sha256(text), 0, doc_id + 1000000000 FROM documents)"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("content_id"), F.sha2("text", 256).alias("hash"), (F.col("n_chars") % 101).cast("int").alias("quality"), "doc_id")
    return rows.unionByName(rows.withColumn("quality", F.lit(0)).withColumn("doc_id", F.col("doc_id") + 1000000000))


@query(f"WITH {OBSERVED_SQL} SELECT content_id, hash, arg_min(quality, doc_id) AS quality FROM o WHERE (content_id, hash) NOT IN (SELECT content_id, hash FROM o WHERE quality > 90) GROUP BY content_id, hash")
def observed_hash_dedup(spark, sf_dir):
    """What an insert adds when pairs of a quality above 90 are stored already; the first quality stays."""
    rows = observed(spark, sf_dir)
    return H.new_hashes(rows, rows.where("quality > 90"), "doc_id").select("content_id", "hash", "quality")


@query(f"WITH {OBSERVED_SQL} SELECT count(*) AS hash_count FROM (SELECT DISTINCT content_id, hash FROM o)")
def observed_hash_count(spark, sf_dir):
    return H.observed_count(H.first_of_each(observed(spark, sf_dir), "doc_id"))


@query(f"WITH {BLOCKED_SQL} SELECT 3::BIGINT AS revision, hash FROM (SELECT 1) LEFT JOIN b ON true")
def blocklist_snapshot(spark, sf_dir):
    """The list of the third write; the first had one hash, the second none."""
    store = H.Blocklist(spark, shared_folder(spark, "blocklist"))
    store.write(spark.createDataFrame([("f" * 64,)], "hash string"))
    store.write(spark.createDataFrame([], "hash string"))
    store.write(blocked_table(spark, sf_dir))
    return store.read()


# Signals of a response


@query(
    f"""WITH {SIGNALS_SQL} SELECT doc_id,
  CASE WHEN content_type = 'POST' THEN CASE WHEN upper(trim(investment)) IN ('RELATED', 'NOT_RELATED', 'UNCERTAIN') THEN upper(trim(investment)) ELSE 'UNCERTAIN' END END AS investment,
  CASE WHEN content_type <> 'USERNAME' THEN CASE WHEN politics = 'not_related' THEN CASE WHEN doc_id % 8 = 0 THEN 'UNCERTAIN' ELSE 'NOT_RELATED' END WHEN trim(politics) = 'High_Risk' THEN 'HIGH_RISK' ELSE 'UNCERTAIN' END END AS politics,
  CASE WHEN media_status IS NOT NULL THEN CASE WHEN matched IS NULL THEN 'UNAVAILABLE' WHEN NOT coalesce(quality_accepted, false) THEN 'LOW_QUALITY' WHEN matched THEN 'MATCHED' ELSE 'NOT_MATCHED' END END AS image_match FROM r"""
)
def response_signals(spark, sf_dir):
    c = F.col
    return signals(spark, sf_dir).select(
        "doc_id",
        investment_signal(c("content_type"), c("investment")).alias("investment"),
        politics_signal(c("content_type"), c("politics"), c("doc_id") % 8 == 0).alias("politics"),
        image_match(c("media_status").isNotNull(), c("matched").isNotNull(), c("quality_accepted"), c("matched")).alias("image_match"),
    )


OCR_SQL = r"SELECT doc_id, d.text AS text, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS seen FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0"


def seen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("raw"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(turns, d["doc_id"] == turns["conv_id"], "left").select("doc_id", "text", "raw", ocr.result(F.concat(F.lit(" \t"), F.col("raw"), F.lit(" \n "))).alias("ocr"))


@query(f"WITH o AS ({OCR_SQL}) SELECT doc_id, CASE WHEN coalesce(seen, '') = '' THEN 'no_text' ELSE 'ok' END AS status, nullif(seen, '') AS seen FROM o")
def ocr_normalize(spark, sf_dir):
    return seen_text(spark, sf_dir).select("doc_id", "ocr.status", F.col("ocr.text").alias("seen"))


@query(
    f"""WITH o AS ({OCR_SQL}), l AS (SELECT *, CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) END || 'Image text:' || chr(10) AS label FROM o)
SELECT doc_id, CASE WHEN coalesce(seen, '') <> '' AND 20000 - length(text) - length(label) > 0 THEN text || label || substr(seen, 1, 20000 - length(text) - length(label)) ELSE text END AS analysis_text FROM l"""
)
def image_analysis_text(spark, sf_dir):
    return seen_text(spark, sf_dir).select("doc_id", ocr.analysis_text(F.col("text"), F.col("ocr.status"), F.col("ocr.text")).alias("analysis_text"))


# Providers: answers are built from labels and parsed again.

MODERATION_RAW = "CASE WHEN doc_id % 10 = 0 THEN '{\"results\":[]}' ELSE '{\"results\":[{\"flagged\":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || ',\"categories\":{\"hate/threatening\":false,\"sexual-minors\":' || CASE WHEN quality = 0 THEN 'true' ELSE '\"true\"' END || ',\"violence\":true},\"category_scores\":{\"hate\":\"0.99\",\"violence\":0.' || doc_id % 10 || ',\"harassment\":0.5}}]}' END"
ANSWER_RAW = "'{\"model\":\"m' || doc_id % 3 || '\",\"output\":[{\"type\":\"reasoning\"},{\"type\":\"message\",\"content\":[{\"type\":\"refusal\"},{\"type\":\"output_text\",\"text\":\"' || CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE '{\\\"action\\\":\\\"' || CASE WHEN quality = 0 THEN 'block' ELSE 'allow' END || '\\\",\\\"category\\\":\\\"none\\\"' || CASE WHEN doc_id % 7 = 0 THEN ',\\\"status\\\":\\\"late\\\"' ELSE '' END || '}' END || '\"}]}]}'"
# Spark's literals read a backslash as an escape, DuckDB's do not.
ANSWER_RAW_SPARK = ANSWER_RAW.replace("\\", "\\\\")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.expr(MODERATION_RAW).alias("moderation_raw"), F.expr(ANSWER_RAW_SPARK).alias("answer_raw"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 <> 0 THEN 'default' END AS model, CASE WHEN doc_id % 10 <> 0 THEN toxic = 1 END AS flagged,
  CASE WHEN doc_id % 10 = 0 THEN 'OTHER' WHEN quality = 0 THEN 'SEXUAL_MINORS' ELSE 'VIOLENCE' END AS violation,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 >= 5 THEN 'violence' ELSE 'harassment' END AS top, CASE WHEN doc_id % 10 = 0 THEN -1 WHEN doc_id % 10 >= 5 THEN (doc_id % 10) / 10.0 ELSE 0.5 END AS score FROM labels"""
)
def provider_parse_moderation(spark, sf_dir):
    m = P.parse_moderation(F.col("moderation_raw"), "default")
    rows = answers(spark, sf_dir).select("doc_id", m.alias("m"))
    entries = F.coalesce(P.true_entries(F.col("m.categories")), F.array().cast("array<struct<key:string,value:boolean>>"))
    return rows.select("doc_id", "m.status", "m.model", "m.flagged", P.first_flagged(entries).alias("violation"), best_score(P.number_entries(F.col("m.category_scores"))).alias("t")).select("doc_id", "status", "model", "flagged", "violation", F.col("t.key").alias("top"), F.col("t.value").alias("score"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'late' ELSE 'ok' END AS status, CASE WHEN doc_id % 6 <> 0 THEN 'm' || doc_id % 3 END AS model,
  CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN quality = 0 THEN 'block' ELSE 'allow' END END AS action, CASE WHEN doc_id % 6 <> 0 THEN 'none' END AS category, doc_id % 6 <> 0 AS follows FROM labels"""
)
def provider_parse_classification(spark, sf_dir):
    c = P.parse_classification(F.col("answer_raw"), "default")
    rows = answers(spark, sf_dir).select("doc_id", c.alias("c"))
    return rows.select("doc_id", "c.status", "c.model", "c.action", "c.category", P.follows_schema(F.lit("USERNAME"), F.col("c")).alias("follows"))


@query("SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM documents")
def data_url(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.data_url(F.encode("text", "UTF-8"), F.lit("image/png")).alias("url"))


@query("SELECT doc_id, text AS input, 'Content type: POST' || chr(10) || 'The content to judge, as its author wrote it:' || chr(10) || '<content>' || text || '</content>' AS content, 120 AS tokens, substr(text, 1, 20000) AS context, 'Content type: POST' || chr(10) || 'Post text: ' || substr(text, 1, 20000) || chr(10) || 'Judge the image together with this text.' AS image_context, 'data:image/png;base64,eA==' AS image_url FROM documents")
def provider_requests(spark, sf_dir):
    """Requests, read back from their JSON."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.from_json(P.moderation_text_request("m", text), "struct<input:string>")["input"].alias("input"),
        F.from_json(P.classification_text_request("m", F.lit("POST"), text), "struct<max_output_tokens:int,input:array<struct<role:string,content:string>>>").alias("c"),
        F.from_json(P.moderation_image_request("m", F.encode(F.lit("x"), "UTF-8"), F.lit("image/png"), text), "struct<input:array<struct<type:string,text:string>>>").alias("i"),
        F.from_json(P.classification_image_request("m", F.lit("POST"), F.encode(F.lit("x"), "UTF-8"), F.lit("image/png"), text), "struct<input:array<struct<role:string,content:string>>>").alias("j"),
    )
    parts = F.from_json(F.col("j.input")[1]["content"], "array<struct<type:string,text:string,image_url:string>>")
    return rows.select("doc_id", "input", F.col("c.input")[1]["content"].alias("content"), F.col("c.max_output_tokens").alias("tokens"), F.col("i.input")[0]["text"].alias("context"), parts[0]["text"].alias("image_context"), parts[1]["image_url"].alias("image_url"))


@query("SELECT doc_id, replace(replace(replace(substr(text, 1, 500), chr(13), ' '), chr(10), ' '), chr(9), ' ') AS message, 'http_503' AS code, 'http_error' AS type, 'unavailable' AS request_id FROM documents")
def provider_errors(spark, sf_dir):
    body = F.to_json(F.struct(F.struct(F.col("text").alias("message"), F.lit(" ").alias("code")).alias("error")))
    return table(spark, sf_dir, "documents").select("doc_id", P.provider_error(body, F.lit(503), F.lit("down"), F.lit(None).cast("string")).alias("e")).select("doc_id", "e.message", "e.code", "e.type", "e.request_id")


# Accuracy: labels as expectation, an imperfect rule as answer, lang as language.

CASE_SQL = """c AS (SELECT 'c' || l.doc_id AS id, CASE l.doc_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'COMMENT' ELSE 'USERNAME' END AS content_type, CASE lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'TR' WHEN 'fr' THEN 'RU' ELSE 'AZ' END AS language,
  CASE WHEN toxic = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS decision, CASE WHEN toxic = 1 THEN 'HARASSMENT' ELSE 'NONE' END AS violation, CASE WHEN l.doc_id % 3 = 0 THEN 'RELATED' END AS investment, CASE WHEN l.doc_id % 3 <> 2 THEN 'NOT_RELATED' END AS politics, text, l.doc_id
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
ANSWER_SQL = "a AS (SELECT id AS aid, doc_id % 50 <> 0 AS ok, CASE WHEN n_bad THEN 'BLOCK' ELSE 'ALLOW' END AS a_decision, CASE WHEN n_bad THEN 'HARASSMENT' ELSE 'NONE' END AS a_violation, CASE WHEN doc_id % 4 <> 0 THEN 'RELATED' END AS a_investment, CASE WHEN doc_id % 5 <> 0 THEN 'NOT_RELATED' ELSE 'UNCERTAIN' END AS a_politics, CASE WHEN doc_id % 60 = 1 THEN 'POST' ELSE content_type END AS a_type FROM (SELECT *, regexp_matches(text, 'stupid|trash|idiot') AS n_bad FROM c))"


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")  # noqa: E741
    kind = F.when(F.col("doc_id") % 3 == 0, "POST").when(F.col("doc_id") % 3 == 1, "COMMENT").otherwise("USERNAME")
    expected = F.struct(
        F.when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW").alias("decision"),
        F.when(F.col("toxic") == 1, "HARASSMENT").otherwise("NONE").alias("violation"),
        F.when(F.col("doc_id") % 3 == 0, "RELATED").alias("investment"),
        F.when(F.col("doc_id") % 3 != 2, "NOT_RELATED").alias("politics"),
    )
    language = F.when(F.col("lang") == "en", "EN").when(F.col("lang") == "de", "TR").when(F.col("lang") == "fr", "RU").otherwise("AZ")
    return l.join(d, "doc_id").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), kind.alias("contentType"), language.alias("language"), "text", expected.alias("expected"), "doc_id")


def answered(cases: DataFrame) -> DataFrame:
    bad, n = F.col("text").rlike("stupid|trash|idiot"), F.col("doc_id")
    return cases.select(
        "id",
        (n % 50 != 0).alias("ok"),
        F.col("id").alias("contentId"),
        F.when(n % 60 == 1, "POST").otherwise(F.col("contentType")).alias("contentType"),
        F.when(bad, "BLOCK").otherwise("ALLOW").alias("decision"),
        F.when(bad, "HARASSMENT").otherwise("NONE").alias("violation"),
        F.when(n % 4 != 0, "RELATED").alias("investment"),
        F.when(n % 5 != 0, "NOT_RELATED").otherwise("UNCERTAIN").alias("politics"),
    )


RIGHT_SQL = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN ok AND coalesce(a_{f} = {f}, false) END AS {f}_right" for f in accuracy.FIELDS)
COMPARED_SQL = f"""{CASE_SQL}, {ANSWER_SQL}, x AS (SELECT c.*, ok, ok AS id_right, ok AND a_type = content_type AS type_right, {RIGHT_SQL} FROM c JOIN a ON id = aid),
y AS (SELECT *, id_right AND type_right AND {" AND ".join(f"coalesce({f}_right, true)" for f in accuracy.FIELDS)} AS case_pass FROM x)"""


@query(
    f"""WITH {COMPARED_SQL}, z AS (
  SELECT 'exact_case' AS metric, 'all' AS value, sum(case_pass::INT) AS n_right, count(*) AS n_total FROM y
  UNION ALL SELECT 'api_success', 'all', sum(ok::INT), count(*) FROM y
  UNION ALL SELECT 'contract', 'all', sum(id_right::INT + type_right::INT), 2 * count(*) FROM y
  UNION ALL SELECT 'content_type', content_type, sum(case_pass::INT), count(*) FROM y GROUP BY 2
  UNION ALL SELECT 'language', language, sum(case_pass::INT), count(*) FROM y GROUP BY 2
  {" ".join(f"UNION ALL SELECT 'field', '{f}', sum({f}_right::INT), count(*) FROM y WHERE {f} IS NOT NULL UNION ALL SELECT 'label:{f}', {f}, sum({f}_right::INT), count(*) FROM y WHERE {f} IS NOT NULL GROUP BY 2" for f in accuracy.FIELDS)}
  UNION ALL SELECT 'label_field', 'all', sum(r::INT), count(*) FROM ({" UNION ALL ".join(f"SELECT {f}_right AS r FROM y WHERE {f} IS NOT NULL" for f in accuracy.FIELDS)}))
SELECT metric, value, n_right, n_total, CASE WHEN n_total = 0 THEN 'n/a' ELSE printf('%.2f', round(n_right * 100.0 / n_total, 10)) END AS percent FROM z"""
)
def accuracy_summary(spark, sf_dir):
    cases = labelled_cases(spark, sf_dir)
    return accuracy.summary(accuracy.compared(cases, answered(cases)))


@query(f"WITH {CASE_SQL} SELECT count(*) AS n, count(DISTINCT id) AS n_ids, 0 AS n_invalid, count(*) = 100 AS valid FROM c")
def dataset_validation(spark, sf_dir):
    return accuracy.dataset_check(labelled_cases(spark, sf_dir), 100)


# The whole pipeline

PIPELINE_SQL = f"""WITH q AS (SELECT d.doc_id, l.doc_id AS label_id, quality, toxic, CASE d.doc_id % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'COMMENT' ELSE 'USERNAME' END AS kind, CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE text END AS text FROM {SOURCE}),
g AS (SELECT *, CASE WHEN kind = 'POST' THEN 'NONE' WHEN kind = 'COMMENT' THEN replace(v, 'IMPERSONATION', 'NONE') ELSE v END AS local FROM (SELECT *, {banned_sql("text")} AS v FROM q WHERE text <> '' AND length(text) <= 20000)),
s AS (SELECT *, kind = 'USERNAME' AND local <> 'NONE' AS named, label_id IS NOT NULL AND doc_id % 10 <> 0 AS m_ok, label_id IS NOT NULL AND doc_id % 6 <> 0 AND doc_id % 7 <> 0 AS c_ok, label_id IS NOT NULL AND doc_id % 6 <> 0 AS said FROM g),
r AS (SELECT *, CASE
  WHEN NOT named AND m_ok AND toxic = 1 THEN CASE WHEN quality = 0 THEN 'BLOCK SEXUAL_MINORS' ELSE 'BLOCK VIOLENCE' END
  WHEN local <> 'NONE' THEN 'BLOCK ' || local
  WHEN NOT m_ok OR NOT c_ok THEN 'UNKNOWN ANALYZER_ERROR'
  WHEN quality = 0 THEN 'BLOCK OTHER'
  WHEN doc_id % 10 >= 7 THEN 'UNKNOWN VIOLENCE'
  WHEN kind = 'POST' THEN 'UNKNOWN NOT_INVESTMENT'
  ELSE 'ALLOW NONE' END AS result FROM s)
SELECT 'c' || doc_id AS content_id, kind AS content_type, split_part(result, ' ', 1) AS decision, split_part(result, ' ', 2) AS violation,
  CASE WHEN NOT named AND kind = 'POST' THEN 'UNCERTAIN' END AS investment, CASE WHEN NOT named AND kind <> 'USERNAME' THEN 'UNCERTAIN' END AS politics, NULL::VARCHAR AS image_match FROM r"""


def pipeline_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content_id"),
        F.when(F.col("doc_id") % 3 == 0, "Post").when(F.col("doc_id") % 3 == 1, "comment").otherwise(" USERNAME").alias("content_type"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text")).alias("text"),
    )
    media = spark.createDataFrame([], moderation.MEDIA)
    said = answers(spark, sf_dir).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content_id"), "moderation_raw", F.col("answer_raw").alias("classification_raw"))
    return requests, media, said


@query(PIPELINE_SQL)
def moderation_pipeline(spark, sf_dir):
    return moderation.moderate(*pipeline_inputs(spark, sf_dir), demo_terms(), D.political_terms())[0]


@query("SELECT 'c' || doc_id AS content_id, 400 AS http_status, 'INVALID_INPUT' AS error_code, CASE WHEN doc_id % 13 = 0 THEN 'text or image is required.' ELSE 'text size must be between 0 and 20000.' END AS message FROM documents WHERE doc_id % 13 = 0 OR length(text) > 20000")
def moderation_rejects(spark, sf_dir):
    return moderation.moderate(*pipeline_inputs(spark, sf_dir), demo_terms(), D.political_terms())[1]


@query(f"WITH {OBSERVED_SQL} SELECT CASE WHEN n > 0 THEN 'ready' ELSE 'unavailable' END AS status, 'ready' AS ai, 'ready' AS media, n AS hash_count, 'disabled' AS ocr FROM (SELECT count(*) AS n FROM (SELECT DISTINCT content_id, hash FROM o))")
def service_status(spark, sf_dir):
    """The status, with the count of the hashes that are stored."""
    count = H.observed_count(H.first_of_each(observed(spark, sf_dir), "doc_id")).first()["hash_count"]
    return moderation.status_table(spark, count, "disabled", True)


# Images. No table has any, so they are made by rule: pixel (x, y) of image i has these values at (x + dx, y + dy).

SHIFTS = [(0, 0), (1, 0), (0, 2), (5, 7)]
#: The hash written out for images that the box filter leaves alone (its windows are one pixel wide up to 128 by 128), in doubles.
PDQ_SQL = f"""WITH i AS (SELECT * FROM (VALUES {", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(SHIFTS))}) t(i, dx, dy)),
p AS (SELECT i, r.r, c.c, floor((c.c + 0.5) * 128 / 64)::INT + dx AS x, floor((r.r + 0.5) * 96 / 64)::INT + dy AS y FROM i, range(64) r(r), range(64) c(c)),
v AS (SELECT i, r, c, 0.299::DOUBLE * ((17 * x + 3 * y) & 255) + 0.587::DOUBLE * ((5 * x + 23 * y) & 255) + 0.114::DOUBLE * ((11 * xor(x, y)) & 255) AS v FROM p),
q AS (SELECT i, least(100, floor(sum(abs(coalesce(trunc((v - below) * 100 / 255), 0)) + abs(coalesce(trunc((v - beside) * 100 / 255), 0))) / 90))::INT AS quality
  FROM (SELECT *, lead(v) OVER (PARTITION BY i, c ORDER BY r) AS below, lead(v) OVER (PARTITION BY i, r ORDER BY c) AS beside FROM v) GROUP BY i),
h AS (SELECT i, k, c, sum(cos(pi() / 128 * (k + 1) * (2 * r + 1)) * v) AS t FROM v, range(16) k(k) GROUP BY i, k, c),
d AS (SELECT i, k, m, sum(cos(pi() / 128 * (m + 1) * (2 * c + 1)) * t) AS x FROM h, range(16) m(m) GROUP BY i, k, m),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x) AS place FROM d),
b AS (SELECT i, 255 - 16 * k - m AS spot, (place > 128)::INT AS bit FROM o),
n AS (SELECT i, spot // 4 AS digit, sum(bit << (3 - spot % 4)::INT)::INT AS value FROM b GROUP BY i, spot // 4)
SELECT 'image-' || i AS content_id, string_agg(substr('0123456789abcdef', value + 1, 1), '' ORDER BY digit) AS hash, any_value(quality) AS quality FROM n JOIN q USING (i) GROUP BY i"""


def drawn(dx: int, dy: int, width: int = 128, height: int = 96):
    """The pixels of a generated image: rows of red, green, blue."""
    import numpy as np

    y, x = np.mgrid[dy : height + dy, dx : width + dx]
    return np.stack([(17 * x + 3 * y) & 255, (5 * x + 23 * y) & 255, (11 * (x ^ y)) & 255], axis=-1).astype(np.uint8)


@query(PDQ_SQL)
def pdq_hash_synthetic(spark, sf_dir):
    """Hashes and qualities of generated images."""
    from verdigris.operators.pdq import hashed

    rows = [(f"image-{i}", 96, 128, 3, bytearray(drawn(dx, dy)[..., ::-1].tobytes())) for i, (dx, dy) in enumerate(SHIFTS)]
    return hashed(spark.createDataFrame(rows, "content_id string, height int, width int, channels int, data binary"))


def png(rgb, width: int | None = None, height: int | None = None) -> bytes:
    """A PNG file of the pixels; its header may tell another size."""
    import struct
    import zlib

    rows, columns, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width or columns, height or rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in rgb))) + chunk(b"IEND", b"")


def image_moderated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document as a post, by doc_id % 6: 0 a blocked image, 1 another one with a political word in it, 2 one without contrast, 3 one of 40,001 pixels each way, 4 no image at all in its bytes, 5 no image."""
    import numpy as np

    from verdigris.operators.pdq import pdq

    from .media import media_signals

    known = drawn(0, 0, 64, 64)
    files = [png(known), png(drawn(40, 9, 64, 64)[::-1].copy()), png(np.full((64, 64, 3), 90, np.uint8)), png(known, 40_001, 40_001), b"no image", None]
    images = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "kind int, image binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6).cast("int").alias("kind"))
    posts = docs.join(images, "kind").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content_id"), F.lit("POST").alias("content_type"), F.lit("a view of the bay").alias("text"), "image", F.lit("image/png").alias("image_content_type"))
    named = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("content_id"), "kind")
    texts = named.select("content_id", F.when(F.col("kind") == 1, " the  governm3nt\n").alias("ocr_raw"), F.lit(False).alias("ocr_failed"))
    moderation = '{"results":[{"flagged":false,"categories":{"violence":false},"category_scores":{"violence":0.1}}]}'
    answer = '{"model":"m","output":[{"type":"message","content":[{"type":"output_text","text":"{\\"action\\":\\"allow\\",\\"category\\":\\"none\\",\\"investment\\":\\"related\\",\\"politics\\":\\"not_related\\"}"}]}]}'
    said = named.select("content_id", F.lit(moderation).alias("moderation_raw"), F.lit(answer).alias("classification_raw"))
    # One bit away from the known image's hash.
    value = pdq(known)[0]
    blocked = spark.createDataFrame([(f"{int(value, 16) ^ 1:064x}",)], "hash string")
    media = media_signals(posts, blocked, shared_folder(spark, "observed"), texts)
    return moderation_plan(posts, media, said)


def moderation_plan(posts: DataFrame, media: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    return moderation.moderate(posts, media, said, demo_terms(), D.political_terms())


@query(
    """SELECT 'c' || doc_id AS content_id, 'POST' AS content_type, CASE doc_id % 6 WHEN 0 THEN 'BLOCK' ELSE 'ALLOW' END AS decision, CASE doc_id % 6 WHEN 0 THEN 'KNOWN_IMAGE' ELSE 'NONE' END AS violation, 'RELATED' AS investment,
  CASE doc_id % 6 WHEN 1 THEN 'UNCERTAIN' ELSE 'NOT_RELATED' END AS politics, CASE doc_id % 6 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'NOT_MATCHED' WHEN 2 THEN 'LOW_QUALITY' END AS image_match FROM documents WHERE doc_id % 6 NOT IN (3, 4)"""
)
def image_moderation(spark, sf_dir):
    """From the bytes of images to responses."""
    return image_moderated(spark, sf_dir)[0]


@query("SELECT 'c' || doc_id AS content_id, 422 AS http_status, 'UNPROCESSABLE_IMAGE' AS error_code, 'image failed media validation.' AS message FROM documents WHERE doc_id % 6 IN (3, 4)")
def image_rejects(spark, sf_dir):
    return image_moderated(spark, sf_dir)[1]
