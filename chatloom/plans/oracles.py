"""DuckDB statements that give the same results as the queries, over whole tables."""

from __future__ import annotations

from chatloom.plans import sqltext as S

_DAY = "CAST(substr(timestamp, 1, 10) AS DATE)"


def _label(a: str, b: str) -> str:
    return f"strftime({a}, '%Y.%m.%d') || '-' || strftime({b}, '%Y.%m.%d')"


def _period(expr_a: str, expr_b: str, pre: str = "") -> str:
    return f"SELECT {_label(expr_a, expr_b)} AS label, count(*) AS n FROM (SELECT {_DAY} AS d{pre} FROM messages) GROUP BY 1"


_TWO = """
WITH a AS (SELECT CAST(date_trunc('week', CAST(substr(timestamp, 1, 10) AS DATE)) AS DATE) AS m FROM messages),
b AS (SELECT m, CAST(date_trunc('year', m) AS DATE) AS j FROM a),
c AS (SELECT m, CAST(ceil((date_diff('day', j, m) + CASE WHEN dayofweek(j) = 0 THEN -6 ELSE 2 - dayofweek(j) END) / 7.0) AS BIGINT) AS n FROM b),
e AS (SELECT CASE WHEN n % 2 = 0 THEN m - 7 ELSE m END AS x, CASE WHEN n % 2 = 0 THEN m + 6 ELSE m + 13 END AS y FROM c)
SELECT strftime(x, '%Y.%m.%d') || '-' || strftime(y, '%Y.%m.%d') AS label, count(*) AS n FROM e GROUP BY 1
"""
_TRIM = S.trim("content")
_RULES = S.content_rules
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY contact, seq, source_zip, loaded_at, sender NULLS FIRST, timestamp) AS r FROM messages WHERE contact IS NOT NULL AND message_id IS NOT NULL) WHERE r = 1)"
_ID = "sha256(coalesce(timestamp, '') || chr(0) || coalesce(sender, '') || chr(0) || coalesce(content, '') || chr(0) || coalesce(media_file, ''))"
_REND = f"(SELECT *, 'm ' || substr(message_id, 1, 6) AS content, CASE WHEN subtype = 'audio' THEN 'fala' END AS transcription, seq % 2 = 0 AS media_exists, type = 'media' AND media_file IS NULL AS om, coalesce(sender, '') AS who FROM {_FIRST})"
_MD = """CASE WHEN type = 'system' THEN tm || '_' || content || '_'
 WHEN type = 'deleted' THEN bold || ' _' || content || '_'
 WHEN om THEN bold || ' <Mídia oculta>' || chr(10) || content
 WHEN type = 'media' AND media_file IS NOT NULL THEN bold || chr(10) || '![[medias/' || media_file || ']]' || CASE WHEN media_exists THEN '' ELSE ' <!-- media:missing -->' END
   || CASE WHEN transcription IS NOT NULL THEN chr(10) || '> **[' || CASE WHEN subtype = 'image' THEN 'Descrição' ELSE 'Transcrição' END || ']** ' || transcription ELSE '' END || chr(10) || content
 ELSE bold || ' ' || content || CASE WHEN edited THEN ' _(editada)_' ELSE '' END END"""
_MDS = f"(SELECT *, {_MD} AS md FROM (SELECT *, '`' || substr(timestamp, 12, 5) || '` ' AS tm, '`' || substr(timestamp, 12, 5) || '` **' || who || ':**' AS bold FROM {_REND}))"
_HEAD = "strftime(d, '%d/%m') || ' ' || ['dom', 'seg', 'ter', 'qua', 'qui', 'sex', 'sáb'][dayofweek(d) + 1]"
_SHOW = lambda i: f"(list_reverse(string_split(string_split(period, '-')[{i}], '.'))[1] || '/' || list_reverse(string_split(string_split(period, '-')[{i}], '.'))[2] || '/' || list_reverse(string_split(string_split(period, '-')[{i}], '.'))[3])"
_ISLES = """(SELECT recording_id, island, any_value(who) AS speaker, count(*) AS n, arg_min(start_time, utt_id) AS s0, arg_max(end_time, utt_id) AS e0,
 first(start_time ORDER BY utt_id) AS start_time, last(end_time ORDER BY utt_id) AS end_time, string_agg(text, ' ' ORDER BY utt_id) AS text
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY utt_id) AS island FROM
  (SELECT utt_id, recording_id, start_time, end_time, coalesce(text, '') AS text, coalesce(speaker, 'Desconhecido') AS who,
   CASE WHEN coalesce(speaker, 'Desconhecido') IS DISTINCT FROM lag(coalesce(speaker, 'Desconhecido')) OVER (PARTITION BY recording_id ORDER BY utt_id) THEN 1 ELSE 0 END AS fresh
   FROM utterances WHERE recording_id IS NOT NULL)) GROUP BY 1, 2)"""
_CLOCK = lambda c: f"coalesce(lpad(CAST(CAST(floor({c} / 60) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor({c} / 60) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor({c}) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor(({c} % 1) * 100) AS BIGINT) AS VARCHAR), 2, '0'), '--:--')"
_SHOT = """SELECT message_id, '### ' || substr(timestamp, 1, 10) || CASE WHEN seq % 3 = 0 THEN ' ⚠️' ELSE '' END || ' ' || substr(timestamp, 12, 5) || ' - ' || coalesce(sender, '') || CASE WHEN edited THEN ' ✏️' ELSE '' END || chr(10)
 || CASE WHEN coalesce(reply_to, '') <> '' THEN '> _Em resposta a:_ "' || reply_to || '"' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN type IN ('media', 'deleted') THEN '> 📎 **[' || CASE WHEN type = 'deleted' THEN 'Apagada' ELSE CASE subtype WHEN 'image' THEN 'Imagem' WHEN 'video' THEN 'Vídeo' WHEN 'document' THEN 'Documento' WHEN 'sticker' THEN 'Figurinha' WHEN 'contact' THEN 'Contato' ELSE upper(substr(subtype, 1, 1)) || substr(subtype, 2) END END || ']**' || CASE WHEN coalesce(media_file, '') <> '' THEN ' ' || media_file ELSE '' END || chr(10) ELSE '' END
 || '> a' || chr(10) || '> ' || contact || chr(10) || CASE WHEN edited THEN '> _✓✓ (lida)_' || chr(10) ELSE '' END AS md FROM messages WHERE message_id IS NOT NULL"""

_SPEECH = f"SELECT recording_id, string_agg('**[' || {_CLOCK('start_time')} || ' - ' || {_CLOCK('end_time')} || '] ' || speaker || ':**' || chr(10) || '> ' || {S.trim('text')} || chr(10), chr(10) ORDER BY island) AS body FROM {_ISLES} GROUP BY 1"
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_SHOWN = lambda c: f"strftime({c}, '%d/%m/%Y às %H:%M:%S')"
# ties of the binary value go up; printf sends them to the even digit
_PERCENT = lambda c: f"CASE WHEN {c} * 400 = floor({c} * 400) AND CAST({c} * 400 AS BIGINT) % 2 = 1 THEN printf('%.1f', {c} * 100 + 0.05) ELSE printf('%.1f', {c} * 100) END || '%'"
_LINES = lambda *xs: " || chr(10) || ".join(xs)
_FACTS = ("'- **Arquivo de origem:** `' || file || '`'", f"'- **Data de criação do arquivo:** ' || {_SHOWN('created')}", f"'- **Data de modificação do arquivo:** ' || {_SHOWN('modified')}")
_AUDIO = _LINES(
    "'---'", "'arquivo_origem: \"' || file || '\"'", f"'data_criacao_arquivo: \"' || {_ISO('created')} || '\"'", f"'data_modificacao_arquivo: \"' || {_ISO('modified')} || '\"'", f"'data_transcricao: \"' || {_ISO('modified')} || '\"'",
    "'idioma_detectado: \"por\"'", f"'probabilidade_idioma: ' || {_PERCENT('pr')}", "'modelo: \"offline\"'", "'---'", "''", "'# Transcrição de Áudio'", "''", "'## Metadados'", "''", *_FACTS,
    f"'- **Data da transcrição:** ' || {_SHOWN('modified')}", f"'- **Idioma detectado:** por (' || {_PERCENT('pr')} || ' de confiança)'", "''", "'---'", "''", "'## Transcrição Completa'", "''", "coalesce(body, '')", "'---'", "''", "'aviso'", "''",
)
_ONE_SHOT = _SHOT.split("SELECT message_id, ", 1)[1].split(" AS md FROM ")[0]
_PAGE = _LINES(
    "'---'", "'arquivo_origem: \"' || file || '\"'", f"'data_criacao_arquivo: \"' || {_ISO('created')} || '\"'", f"'data_modificacao_arquivo: \"' || {_ISO('modified')} || '\"'", f"'data_extracao: \"' || {_ISO('modified')} || '\"'",
    "'chat: \"' || contact || '\"'", "'tipo_chat: \"' || CASE WHEN who > 2 THEN 'group' ELSE 'individual' END || '\"'", "'total_mensagens: ' || n", "'datas_inferidas: ' || inferred", "'---'", "''", "'# Transcrição de Captura WhatsApp'", "''",
    "'## Metadados'", "''", *_FACTS, f"'- **Data da extração:** ' || {_SHOWN('modified')}", "'- **Chat:** ' || contact", "'- **Tipo:** ' || CASE WHEN who > 2 THEN 'Grupo' ELSE 'Conversa individual' END", "'- **Total de mensagens:** ' || n",
    "CASE WHEN who > 2 THEN '- **Participantes:** ' || who || chr(10) ELSE '' END || '- **Separadores de data visíveis:** ' || seps",
    "CASE WHEN inferred > 0 THEN chr(10) || '> ⚠️ **Nota:** ' || inferred || ' mensagem(ns) com data inferida a partir de \"HOJE\"/\"ONTEM\" e data do arquivo.' || chr(10) ELSE '' END || CASE WHEN page = 0 THEN chr(10) || '## Contexto do Sistema' || chr(10) || chr(10) || '> início' || chr(10) ELSE '' END",
    "'---'", "''", "'## Mensagens'", "''", "md", "'---'", "''", "'## Legenda'", "''", "'- ⚠️ Data inferida (não explícita na captura)'", "'- ↩️ Mensagem encaminhada'", "'- ✏️ Mensagem editada'",
    "'- 📎 Anexo de mídia'", "'- ✓ Enviada | ✓✓ Entregue | ✓✓ (lida) Visualizada'", "''", "'---'", "''", "'*Transcrito automaticamente de captura de tela do WhatsApp*'", "''",
)
_KNOWN = "(SELECT contact, filename, source_zip, e FROM (SELECT contact_name AS contact, filename, source_zip, lower(list_last(string_split(filename, '.'))) AS e, row_number() OVER (PARTITION BY contact_name, filename ORDER BY zip_order, source_zip) AS r FROM (SELECT *, unnest(media_files) AS filename FROM archives)) WHERE r = 1)"
_DONE = f"(SELECT contact, filename, CASE WHEN e IN ('opus', 'mp4', 'm4a', 'mp3', 'ogg', 'oga', 'jpg', 'jpeg') THEN 'processed' ELSE 'skipped' END AS status, {S.media_kind('e')} AS type, source_zip, CASE WHEN e IN ('opus', 'mp4', 'm4a', 'mp3', 'ogg', 'oga') THEN '[' || filename || ']' WHEN e IN ('jpg', 'jpeg') THEN 'Eu: [' || filename || ']' END AS transcription FROM {_KNOWN})"

ORACLES = {
    "flagship_sender_weeks": f"WITH {S.MESSAGES}, dy AS (SELECT sender, CAST(CAST(make_date(CAST(substr(timestamp, 1, 4) AS INT), 1, 1) AS DATE) + to_months(CAST(substr(timestamp, 6, 2) AS INT) - 1) + to_days(CAST(substr(timestamp, 9, 2) AS INT) - 1) AS DATE) AS d FROM msg) SELECT sender, {_label('m', 'm + 6')} AS period, count(*) AS messages FROM (SELECT sender, CAST(date_trunc('week', d) AS DATE) AS m FROM dy) GROUP BY 1, 2",
    "parse_chat_log": f"WITH {S.MESSAGES} SELECT source_zip, CAST(pos AS INTEGER) AS pos, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, timestamp, sender, content, kind AS type, subtype, media_file, omitted AS is_media_omitted, edited FROM msg",
    "detect_date_format": f"WITH {S.LOG}, {S.FORMATS} SELECT source_zip, date_format FROM fm",
    "range_line_join": f"WITH {S.BLOCKS} SELECT source_zip, CAST(sum(line_end - line_start + 1) AS BIGINT) AS lines, count(*) AS messages FROM b GROUP BY 1",
    "dedup_media_variant": f"WITH RECURSIVE {S.DEDUP} SELECT o.r AS row_id, o.p AS slot FROM kept",
    "merge_upsert_media": f"WITH RECURSIVE {S.MERGE} SELECT contact, archive, action, pos, seq FROM acts",
    "merge_counts": f"WITH RECURSIVE {S.MERGE} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'upgraded') AS upgraded, count(*) FILTER (action = 'replaced') AS replaced, count(*) FILTER (action = 'deleted') AS deleted FROM acts",
    "merge_incremental": f"WITH RECURSIVE {S.MERGE} SELECT contact, message_id, seq FROM ix WHERE NOT EXISTS (SELECT 1 FROM acts WHERE action = 'deleted' AND acts.contact = ix.contact AND acts.seq = ix.seq) UNION ALL SELECT contact, id AS message_id, seq FROM acts WHERE action IN ('added', 'upgraded')",
    "detect_self": "WITH o AS (SELECT DISTINCT source_zip, self AS owner FROM ingest_options WHERE self IS NOT NULL), p AS (SELECT DISTINCT owner, contact, sender FROM messages JOIN o USING (source_zip) WHERE sender <> ''), n AS (SELECT owner, count(DISTINCT contact) AS n FROM p GROUP BY 1), f AS (SELECT owner, sender FROM p JOIN n USING (owner) GROUP BY owner, sender, n HAVING count(*) = n AND n > 1) SELECT owner, min(sender) AS self_name FROM f GROUP BY 1 HAVING count(*) = 1",
    "alias_display_sender": "SELECT contact, CASE WHEN o.self IS NOT NULL AND sender IN (o.self, upper(o.self)) THEN CASE WHEN c.type <> 'group' THEN 'Eu' ELSE upper(o.self) END ELSE coalesce(sender, '') END AS shown, count(*) AS n FROM messages m JOIN contacts c USING (contact) LEFT JOIN (SELECT DISTINCT source_zip, self FROM ingest_options) o USING (source_zip) GROUP BY 1, 2",
    "ingest_media": f"SELECT contact, filename, status, type, source_zip, transcription FROM {_DONE}",
    "media_left_join": f"SELECT m.contact, count(*) AS n, count(d.filename) AS present, count(d.transcription) AS transcribed FROM (SELECT * FROM messages WHERE media_file IS NOT NULL) m LEFT JOIN {_DONE} d ON d.contact = m.contact AND d.filename = m.media_file GROUP BY 1",
    "media_registration": f"WITH k AS (SELECT * FROM {_KNOWN}), x AS (SELECT contact, media_file AS filename, source_zip, lower(list_last(string_split(media_file, '.'))) AS e, row_number() OVER (PARTITION BY contact, media_file ORDER BY zip_order, source_zip) AS r FROM messages JOIN archives USING (source_zip) WHERE media_file IS NOT NULL) SELECT contact, filename, 'processed' AS status, {S.media_kind('e')} AS type, source_zip FROM k UNION ALL SELECT contact, filename, 'pending', {S.media_kind('e')}, source_zip FROM x ANTI JOIN k USING (contact, filename) WHERE r = 1",
    "media_placement": "SELECT DISTINCT contact, period, media_file FROM messages m WHERE EXISTS (SELECT 1 FROM archives a WHERE a.contact_name = m.contact AND list_contains(media_files, m.media_file))",
    "audio_document": f"SELECT recording_id, md5({_AUDIO}) AS body_md5 FROM (SELECT recording_id, recording_id || '.opus' AS file, min(loaded_at) AS created, max(loaded_at) AS modified, count(speaker) / count(*) AS pr FROM utterances WHERE recording_id IS NOT NULL GROUP BY 1) LEFT JOIN ({_SPEECH}) USING (recording_id)",
    "screenshot_document": f"SELECT contact, page, md5({_PAGE}) AS body_md5 FROM (SELECT contact, CAST(floor((seq - 1) / 20) AS BIGINT) AS page, contact || '.jpg' AS file, min(loaded_at) AS created, max(loaded_at) AS modified, count(*) AS n, count(*) FILTER (seq % 3 = 0) AS inferred, count(DISTINCT coalesce(sender, '')) AS who, string_agg({_ONE_SHOT}, chr(10) ORDER BY seq, message_id) AS md, array_to_string(list_transform(list_sort(list_transform(list_distinct(list(substr(timestamp, 1, 10))), lambda v: {{'k': list_position(list(substr(timestamp, 1, 10) ORDER BY seq, message_id), v), 'v': v}})), lambda x: x.v), ', ') AS seps FROM {_FIRST} GROUP BY 1, 2)",
    "image_descriptions": f"SELECT contact, CAST(floor((seq - 1) / 20) AS BIGINT) AS page, string_agg(coalesce(sender, '') || ': m ' || substr(message_id, 1, 6), chr(10) ORDER BY seq, message_id) AS description FROM {_FIRST} GROUP BY 1, 2",
    "file_facts": f"SELECT row_id, {_ISO('loaded_at')} AS iso, {_SHOWN('loaded_at')} AS shown, {_PERCENT('(row_id % 1000 / 800.0)')} AS percent, base64(encode(coalesce(content, ''))) AS payload FROM parsed",
    "cleanup_section": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text WHEN doc_id % 3 = 0 THEN text || chr(10) WHEN doc_id % 3 = 1 THEN text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Outra' || chr(10) || chr(10) || 'fim' || chr(10) ELSE text || chr(10) || '---' || chr(10) || chr(10) || '> **Aviso Legal:** nada' || chr(10) || 'mais' || chr(10) END AS body FROM documents WHERE text IS NOT NULL",
    "render_period_document": f"WITH x AS (SELECT *, {_DAY} AS d, CASE WHEN substr(timestamp, 6, 5) IS DISTINCT FROM lag(substr(timestamp, 6, 5)) OVER (PARTITION BY contact, period ORDER BY seq, message_id) THEN 1 ELSE 0 END AS fresh FROM {_MDS}), r AS (SELECT *, sum(fresh) OVER (PARTITION BY contact, period ORDER BY seq, message_id) AS run FROM x), y AS (SELECT contact, period, run, first(d ORDER BY seq, message_id) AS d, count(*) AS n, string_agg(md, chr(10) || chr(10) ORDER BY seq, message_id) || chr(10) AS b FROM r GROUP BY 1, 2, 3), z AS (SELECT contact, period, CAST(sum(n) AS BIGINT) AS messages, string_agg('## ' || {_HEAD} || chr(10) || chr(10) || b, chr(10) ORDER BY run) AS t FROM y GROUP BY 1, 2) SELECT contact, period, messages, sanitized_name || '/' || period || '.md' AS path, md5('---' || chr(10) || 'contact: ' || sanitized_name || chr(10) || 'type: ' || type || chr(10) || 'period: ' || period || chr(10) || 'messages: ' || messages || chr(10) || 'sources:' || chr(10) || array_to_string(list_transform(list_sort(source_zips), lambda q: '  - ' || q), chr(10)) || chr(10) || '---' || chr(10) || chr(10) || '# ' || sanitized_name || ' — ' || {_SHOW(1)} || ' a ' || {_SHOW(2)} || chr(10) || chr(10) || t) AS body_md5 FROM z JOIN contacts USING (contact)",
    "start_lines": f"SELECT doc_id, i - 1 AS line_no, coalesce(b[1], e[1]) AS d, coalesce(b[2], e[2]) AS t, coalesce(b[3], e[4]) AS body FROM (SELECT doc_id, i, CASE WHEN regexp_matches(line, '{S.BRACKETED}') THEN regexp_extract(line, '{S.BRACKETED}', ['d', 't', 'x']) END AS b0, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)) , LATERAL (SELECT CASE WHEN b0 IS NOT NULL THEN [b0.d, b0.t, b0.x] END AS b, CASE WHEN regexp_matches(line, '{S.DASHED}') THEN [regexp_extract(line, '{S.DASHED}', 1), regexp_extract(line, '{S.DASHED}', 2), regexp_extract(line, '{S.DASHED}', 3), regexp_extract(line, '{S.DASHED}', 4)] END AS e) WHERE b IS NOT NULL OR e IS NOT NULL",
    "parse_warnings": f"WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS source_zip, i, regexp_matches(line, '{S.BRACKETED}') OR regexp_matches(line, '{S.DASHED}') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)), f AS (SELECT source_zip, min(i) AS first FROM l WHERE s GROUP BY 1) SELECT source_zip, count(*) AS warnings FROM l LEFT JOIN f USING (source_zip) WHERE first IS NULL OR i < first GROUP BY 1",
    "split_sender": f"SELECT row_id, CASE WHEN sys THEN '' WHEN p > 0 THEN substr(content, 1, p - 1) ELSE substr(content, 1, strpos(content, ':') - 1) END AS sender, CASE WHEN sys THEN content WHEN p > 0 THEN substr(content, p + 2) ELSE regexp_replace(substr(content, strpos(content, ':') + 1), '^[{S.WS}]+', '') END AS raw, sys AS system FROM (SELECT *, (p = 0 AND NOT (ends_with(content, ':') OR contains(content, ':' || chr(10)))) OR ({S.has_any('lower(content)', S.SYSTEM)} AND p > 51) AS sys FROM (SELECT row_id, content, strpos(content, ': ') AS p FROM parsed WHERE content IS NOT NULL))",
    "content_rules": f"SELECT row_id, c.kind AS type, c.content AS content, c.edited AS edited, c.omitted AS omitted FROM (SELECT row_id, {_RULES('x0')} AS c FROM (SELECT row_id, coalesce(content, '') AS x0 FROM parsed))",
    "system_subtype": f"SELECT row_id, {S.system_kind('content')} AS kind, {S.has_any('lower(content)', S.SYSTEM)} AS is_system FROM parsed WHERE content IS NOT NULL",
    "media_kind": f"SELECT row_id, {S.media_kind('e')} AS kind, CASE e WHEN 'm4a' THEN 'audio/x-m4a' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4' WHEN 'opus' THEN 'audio/opus' WHEN 'ogg' THEN 'audio/ogg' WHEN 'oga' THEN 'audio/ogg' ELSE 'application/octet-stream' END AS mime, e IN ('opus', 'mp4', 'm4a', 'mp3', 'ogg', 'oga') AS is_audio, e IN ('jpg', 'jpeg') AS is_image, regexp_replace(media_file, '\\.[^.]+$', '.md') AS sidecar FROM (SELECT row_id, media_file, lower(list_last(string_split(media_file, '.'))) AS e FROM parsed WHERE media_file IS NOT NULL)",
    "message_id": f"SELECT row_id, {_ID} AS message_id FROM parsed",
    "dedup_first": f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY source_zip, {_ID} ORDER BY pos, row_id) AS r FROM parsed) WHERE r = 1",
    "period_1w": _period("CAST(date_trunc('week', d) AS DATE)", "CAST(date_trunc('week', d) AS DATE) + 6"),
    "period_2w": _TWO,
    "period_1mo": _period("CAST(date_trunc('month', d) AS DATE)", "last_day(d)"),
    "period_3mo": _period("CAST(date_trunc('quarter', d) AS DATE)", "last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE))"),
    "period_1y": _period("CAST(date_trunc('year', d) AS DATE)", "make_date(year(d), 12, 31)"),
    "period_boundaries_1w": f"SELECT DISTINCT contact, {_label('m', 'm + 6')} AS label FROM (SELECT contact, CAST(date_trunc('week', unnest(generate_series(min({_DAY}), max({_DAY}), INTERVAL 1 DAY))) AS DATE) AS m FROM messages GROUP BY contact)",
    "order_quarters": "SELECT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS q_start, CAST(last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS VARCHAR) AS q_end, count(*) AS n FROM orders GROUP BY 1, 2",
    "contact_periods": "SELECT DISTINCT contact, period FROM messages",
    "contact_message_count": "SELECT contact, count(*) AS message_count, max(seq) AS max_seq FROM messages GROUP BY 1",
    "day_headers": f"SELECT contact, period, seq, {_HEAD} AS header FROM (SELECT *, {_DAY} AS d, lag(substr(timestamp, 6, 5)) OVER (PARTITION BY contact, period ORDER BY seq, message_id, source_zip) AS p FROM messages WHERE contact IS NOT NULL) WHERE p IS DISTINCT FROM substr(timestamp, 6, 5)",
    "group_test": f"SELECT source_zip, coalesce(bool_or(type = 'system' AND {S.has_any('lower(coalesce(content, chr(32)))', S.GROUP_SIGNS)}), false) OR count(DISTINCT CASE WHEN type <> 'system' AND sender <> '' THEN sender END) > 2 AS is_group FROM parsed GROUP BY 1",
    "overlap_votes": f"WITH p AS (SELECT source_zip, batch_no, {_ID} AS id, row_id FROM parsed), o AS (SELECT id, min(contact_name) AS contact FROM p JOIN archives USING (source_zip) WHERE batch_no = 0 GROUP BY 1), n AS (SELECT source_zip, id, min(row_id) AS slot, count(*) AS c, zip_order FROM p JOIN archives USING (source_zip) WHERE batch_no > 0 GROUP BY source_zip, id, zip_order), h AS (SELECT id, arg_min(source_zip, zip_order) AS holder, min(zip_order) AS ho FROM n GROUP BY 1) SELECT source_zip, contact, CASE WHEN contact IS NULL THEN holder END AS holder, CAST(sum(c) AS BIGINT) AS votes, min(slot) AS first FROM n JOIN h USING (id) LEFT JOIN o USING (id) WHERE contact IS NOT NULL OR ho < zip_order GROUP BY 1, 2, 3",
    "latest_meta": "SELECT contact_name, max({'z': zip_order, 'f': detected_format}).f AS date_format, arg_max({'e': encoding}, zip_order).e AS encoding, count(*) AS archives FROM archives GROUP BY 1",
    "sanitize_name": rf"""SELECT contact, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ..a/b:' || contact || '?*._ ', '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '_+', '_', 'g'), '^[.{S.WS}]+|[.{S.WS}]+$', '', 'g'), '_+$', ''), 200) AS safe FROM contacts WHERE contact IS NOT NULL""",
    "contact_from_zip": r"SELECT source_zip, CASE WHEN regexp_matches(source_zip, '(?i)^WhatsApp Chat with .+?\.zip$') THEN regexp_extract(source_zip, '(?i)^WhatsApp Chat with (.+?)\.zip$', 1) WHEN regexp_matches(source_zip, '(?i)^Conversa do WhatsApp com .+?\.zip$') THEN regexp_extract(source_zip, '(?i)^Conversa do WhatsApp com (.+?)\.zip$', 1) ELSE regexp_replace(source_zip, '(?i)\.zip$', '') END AS contact, CASE WHEN regexp_matches(source_zip, '(?i)Conversa do WhatsApp') THEN 'pt-br' ELSE 'en' END AS language FROM archives",
    "pending_anti_join": r"WITH p AS (SELECT DISTINCT source_zip || '/' || unnest(media_files) AS path FROM archives), d AS (SELECT regexp_replace(path, '\.[^.]+$', '.md') AS s FROM p WHERE regexp_matches(path, '[02468]\.[a-z0-9]+$')) SELECT path FROM p WHERE regexp_replace(path, '\.[^.]+$', '.md') NOT IN (SELECT s FROM d)",
    "utterance_islands": f"SELECT recording_id, CAST(island AS BIGINT) AS island, speaker, n, start_time, end_time, text FROM {_ISLES}",
    "format_timestamp": f"SELECT utt_id, {_CLOCK('start_time')} AS clock FROM utterances",
    "speech_document": _SPEECH,
    "render_messages": f"SELECT message_id, md FROM {_MDS}",
    "screenshot_markdown": _SHOT,
    "stats_union": "WITH p AS (SELECT batch_no, CASE WHEN is_media_omitted THEN 'failed' WHEN type = 'media' THEN 'processed' ELSE 'skipped' END AS s FROM parsed), q AS (SELECT s FROM p UNION ALL SELECT s FROM p WHERE batch_no > 0) SELECT CAST(count(*) FILTER (s = 'processed') AS BIGINT) AS processed, CAST(count(*) FILTER (s = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (s = 'skipped') AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS pending, CAST(count(*) AS BIGINT) AS total FROM q",
    "windowed_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS sender, count(*) AS messages FROM events GROUP BY 1, 2",
    "trimmed_contents": f"SELECT row_id, length({_TRIM}) AS n FROM parsed WHERE content IS NOT NULL",
}
