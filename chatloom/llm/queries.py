"""The llm queries of the driver contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import (
    batches,
    conversations,
    encodings,
    evaluation_leaks,
    mixing,
    personal_data,
    sentences,
    survivors,
    turns,
)
from chatloom.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.found(read(spark, d, "utterances"))


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(read(spark, d, "utterances"))


def p1_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Turns in which unidentified utterances take the speaker a fitted model gives them."""
    utts = read(spark, d, "utterances")
    return turns.speaker_turns(utts, unidentified="infer", model=turns.fit_model(utts))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.drop_reasons(read(spark, d, "contacts"), read(spark, d, "messages"))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild_conversations(read(spark, d, "messages"), read(spark, d, "ingest_options"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.ordered_conversations(read(spark, d, "contacts"), read(spark, d, "messages"), read(spark, d, "ingest_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.found(read(spark, d, "parsed"), read(spark, d, "utterances"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.redact(*personal_data.tables(read(spark, d, "parsed"), read(spark, d, "utterances")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.found(read(spark, d, "parsed"), read(spark, d, "archives"), read(spark, d, "ingest_options"))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(read(spark, d, "parsed"), read(spark, d, "archives"), read(spark, d, "ingest_options"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.found(read(spark, d, "parsed"), read(spark, d, "archives"))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restore(read(spark, d, "parsed"), archives=read(spark, d, "archives"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.find_repeats(read(spark, d, "parsed"), read(spark, d, "archives"), read(spark, d, "ingest_options"))


def p6_incremental(spark: SparkSession, d: str) -> DataFrame:
    return batches.find_repeats_by_batch(read(spark, d, "parsed"), read(spark, d, "archives"), read(spark, d, "ingest_options"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = evaluation_leaks.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))
    return leaks.filter("distance = 0").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation_leaks.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "source_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "source_targets"))[1]


def p9_capped(spark: SparkSession, d: str) -> DataFrame:
    """A total of four fifths of everything, where small sources reach their caps; sizes in code points."""
    report = mixing.mix(read(spark, d, "documents"), read(spark, d, "source_targets"), share_of_all=0.8, size=F.length("text"))[1]
    return report.select("source", "available", F.round("wanted", 3).alias("wanted"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(read(spark, d, "documents"))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(read(spark, d, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_INVIS = r"[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{fe00}-\x{fe0f}\x{feff}]"
_KANA = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"
_WHO = f"nullif(trim(regexp_replace(lower(strip_accents(regexp_replace(sender, '{_INVIS}', '', 'g'))), '[~\\s\\x{{a0}}]+', ' ', 'g')), '')"
_STREAM = lambda c: f"regexp_extract_all(lower(strip_accents(regexp_replace({c}, '{_INVIS}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"

_SQL = {
    # rows of one id once; then the three reasons in order
    "p2_found": f"""
WITH m AS (SELECT contact, message_id, min({{'q': seq, 't': CAST(replace(timestamp, 'T', ' ') AS TIMESTAMP), 'w': {_WHO}, 's': type IN ('text', 'media')}}) AS v FROM messages WHERE contact IS NOT NULL GROUP BY 1, 2),
r AS (SELECT contact, v.q AS q, v.t AS t, v.w AS w, v.s AS s, row_number() OVER (PARTITION BY contact ORDER BY v.q, v.t) AS n, lag(v.t) OVER (PARTITION BY contact ORDER BY v.q, v.t) AS p FROM m),
g AS (SELECT contact, bool_or(q IS DISTINCT FROM n OR coalesce(t < p, false)) AS broken, min(w) FILTER (s) AS lo, max(w) FILTER (s) AS hi FROM r GROUP BY 1)
SELECT * FROM (SELECT contact, CASE WHEN lo IS NULL THEN 'empty' WHEN broken THEN 'broken' WHEN lo = hi THEN 'no_reply' END AS reason FROM (SELECT DISTINCT contact FROM contacts WHERE contact IS NOT NULL) LEFT JOIN g USING (contact)) WHERE reason IS NOT NULL""",
    # sources in the order in which they fill up: those before the first that doesn't are at their caps
    "p9_capped": """
WITH a AS (SELECT t.source, target_share AS w, CAST(coalesce(sum(length(text)) FILTER (doc_id IS NOT NULL), 0) AS BIGINT) AS available, max_repeats FROM source_targets t LEFT JOIN documents d USING (source) GROUP BY ALL),
g AS (SELECT 0.8 * sum(available) AS total FROM a), b AS (SELECT *, available * max_repeats AS cap FROM a),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(w) OVER (ORDER BY cap / w DESC, source DESC) AS w_left FROM b WHERE cap > 0 AND w > 0),
c AS (SELECT *, cap <= (total - full_before) * w / w_left AS capped FROM o, g),
r AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (capped), 0)) / sum(w) FILTER (NOT capped) AS level FROM c)
SELECT b.source, b.available, round(CASE WHEN c.source IS NULL THEN 0.0 WHEN capped THEN b.cap ELSE level * b.w END, 3) AS wanted FROM b LEFT JOIN c USING (source), r""",
    # twelve words in a row, or twenty-four characters of a Japanese item
    "p8_found": f"""
WITH i AS (SELECT item_id, lang = 'ja' AS ja, {_STREAM('text')} AS w FROM eval_items), d AS (SELECT doc_id, {_STREAM('text')} AS w, regexp_matches(text, '{_KANA}') AS ja FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE NOT ja)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ij AS (SELECT item_id, substr(s, k, 24) AS x FROM (SELECT item_id, s, unnest(range(1, length(s) - 22)) AS k FROM (SELECT item_id, array_to_string(w, '') AS s FROM i WHERE ja))),
dj AS (SELECT doc_id, substr(s, k, 24) AS x FROM (SELECT doc_id, s, unnest(range(1, length(s) - 22)) AS k FROM (SELECT doc_id, array_to_string(w, '') AS s FROM d WHERE ja)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x) UNION SELECT DISTINCT doc_id, item_id FROM dj JOIN ij USING (x)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
