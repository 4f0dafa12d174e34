"""Pieces of DuckDB SQL shared by the oracle statements. They share nothing with the functions they check."""

from __future__ import annotations

# Phrases and forms of the export format, stated once more for the check.
DELETED = ["Esta mensagem foi apagada", "Você apagou esta mensagem", "This message was deleted", "You deleted this message"]
EDITED = ["<This message was edited>", "(editada)", "(edited)"]
OMITTED = ["<Media omitted>", "<Mídia oculta>"]
ENCRYPTION = ["end-to-end encrypted", "criptografia de ponta a ponta", "protegidas com a criptografia"]
CALL = ["chamada de voz", "chamada de vídeo", "missed voice call", "missed video call", "voice call", "video call"]
ADMIN = ["created group", "criou o grupo", "changed the subject", "alterou o assunto", "changed the group description", "changed this group's icon", "changed the group's"]
MEMBERSHIP = ["added you", "added", "removed", "left", "adicionou você", "adicionou", "removeu", "saiu"]
GROUP_SIGNS = ["created group", "criou o grupo", "added you", "adicionou você"]
EXTENSIONS = {"audio": ["opus", "ogg", "oga", "m4a"], "image": ["jpg", "jpeg", "png"], "video": ["mp4", "3gp"], "sticker": ["webp"], "contact": ["vcf"]}
# White space as the parser counts it, and the line ends its dot doesn't cross.
WS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
REST = r"([^\n\r\x{2028}\x{2029}]*)"
BRACKETED = rf"^\[(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}),?[{WS}](\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\][{WS}]{REST}$"
DASHED = rf"^\[?(\d{{1,2}}/\d{{1,2}}/\d{{2,4}}),?[{WS}](\d{{1,2}}:\d{{2}}(?::\d{{2}})?)(?:[{WS}]([AP]M))?\]?[{WS}][-–][{WS}]{REST}$"
ATTACHED = rf"^([^\n\r\x{{2028}}\x{{2029}}]+)[{WS}]\((?:file attached|arquivo anexado)\)$"
SYSTEM = [*ENCRYPTION, *CALL, *ADMIN, *MEMBERSHIP]


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(p)})" for p in phrases) + ")"


def system_kind(c: str) -> str:
    low = f"lower({c})"
    return f"CASE WHEN {has_any(low, ENCRYPTION)} THEN 'encryption' WHEN {has_any(low, CALL)} THEN 'call' WHEN {has_any(low, ADMIN)} THEN 'admin' WHEN {has_any(low, MEMBERSHIP)} THEN 'membership' ELSE 'other' END"


def media_kind(ext: str) -> str:
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(map(quote, e))}) THEN {quote(k)}" for k, e in EXTENSIONS.items()) + " ELSE 'document' END"


def remove_first(c: str, needle: str) -> str:
    n = quote(needle)
    return f"(substr({c}, 1, strpos({c}, {n}) - 1) || substr({c}, strpos({c}, {n}) + {len(needle)}))"


def content_rules(c: str) -> str:
    """Struct kind, content, edited, omitted, file."""
    t = c
    for m in EDITED:
        t = f"(SELECT CASE WHEN contains(v, {quote(m)}) THEN {trim(remove_first('v', m))} ELSE v END FROM (SELECT {t} AS v))"
    gone = f"{trim(c)} IN ({', '.join(map(quote, DELETED))})"
    rest = f"CASE WHEN contains(w, {quote(OMITTED[0])}) THEN {trim(remove_first('w', OMITTED[0]))} ELSE {trim(remove_first('w', OMITTED[1]))} END"
    name = f"CASE WHEN regexp_matches(string_split(w, chr(10))[1], '{ATTACHED}') THEN {trim(f'''regexp_extract(string_split(w, chr(10))[1], '{ATTACHED}', 1)''')} END"
    tail = f"array_to_string(list_slice(ls, CASE WHEN {trim('coalesce(ls[2], chr(1))')} = nm THEN 3 ELSE 2 END, len(ls)), chr(10))"
    return (
        f"(SELECT {{'kind': CASE WHEN {gone} THEN 'deleted' WHEN om OR nm IS NOT NULL THEN 'media' ELSE 'text' END, 'content': CASE WHEN {gone} THEN {trim(c)} WHEN om THEN {rest} WHEN nm IS NOT NULL THEN {trim(tail)} ELSE w END, "
        f"'edited': NOT ({gone}) AND {has_any(c, EDITED)}, 'omitted': NOT ({gone}) AND om, 'file': CASE WHEN NOT ({gone}) AND NOT om THEN nm END}} "
        f"FROM (SELECT w, string_split(w, chr(10)) AS ls, {has_any('w', OMITTED)} AS om, {name} AS nm FROM (SELECT {t} AS w)))"
    )


#: Log lines written from parsed, as the queries write them: source_zip, line_no, line.
_STAMP = """CASE row_id % 4 WHEN 0 THEN printf('%d/%d/%02d, %02d:%02d - ', a, b, y % 100, h, m) WHEN 1 THEN printf('[%02d/%02d/%d, %02d:%02d:%02d] ', a, b, y, h, m, s)
 WHEN 2 THEN printf('%d/%d/%02d, %d:%02d', a, b, y % 100, (h + 11) % 12 + 1, m) || CASE WHEN row_id % 8 = 2 THEN ' ' ELSE chr(8239) END || CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END || ' - ' ELSE printf('%d/%d/%d %02d:%02d:%02d – ', a, b, y, h, m, s) END"""
_SAID = """CASE WHEN media_file IS NOT NULL THEN media_file || CASE WHEN row_id % 2 = 0 THEN ' (file attached)' ELSE ' (arquivo anexado)' END || CASE WHEN row_id % 3 = 0 THEN chr(10) || media_file ELSE '' END || cap
 WHEN coalesce(is_media_omitted, false) THEN CASE WHEN row_id % 2 = 0 THEN '<Media omitted>' ELSE '<Mídia oculta>' END || cap ELSE c END"""
LOG = f"""p0 AS (SELECT *, coalesce(content, '') AS c, CASE WHEN coalesce(content, '') <> '' THEN chr(10) || content ELSE '' END AS cap, 1 + row_id % 28 AS dd, 1 + row_id % 12 AS mo, 2024 + row_id % 3 AS y, row_id % 24 AS h, row_id % 60 AS m, (row_id // 7) % 60 AS s FROM parsed),
p1 AS (SELECT *, CASE WHEN length(source_zip) % 2 = 0 THEN dd ELSE mo END AS a, CASE WHEN length(source_zip) % 2 = 0 THEN mo ELSE dd END AS b FROM p0),
p2 AS (SELECT source_zip, pos, row_id, string_split({_STAMP} || CASE WHEN coalesce(sender, '') = '' THEN c ELSE sender || ': ' || ({_SAID}) END, chr(10)) AS ls FROM p1),
l AS (SELECT source_zip, row_number() OVER (PARTITION BY source_zip ORDER BY pos, row_id, i) AS line_no, line FROM (SELECT source_zip, pos, row_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM p2))"""
#: Blocks of lines that make one message; x holds date, time, half and body of its first line.
BLOCKS = f"""{LOG},
s AS (SELECT *, CASE WHEN regexp_matches(line, '{BRACKETED}') THEN {{'d': regexp_extract(line, '{BRACKETED}', 1), 't': regexp_extract(line, '{BRACKETED}', 2), 'h': '', 'b': regexp_extract(line, '{BRACKETED}', 3)}}
  WHEN regexp_matches(line, '{DASHED}') THEN {{'d': regexp_extract(line, '{DASHED}', 1), 't': regexp_extract(line, '{DASHED}', 2), 'h': regexp_extract(line, '{DASHED}', 3), 'b': regexp_extract(line, '{DASHED}', 4)}} END AS x FROM l),
k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN line_no END) OVER (PARTITION BY source_zip ORDER BY line_no) AS line_start FROM s),
b AS (SELECT source_zip, line_start, max(line_no) AS line_end, max(x.d) AS d, max(x.t) AS t, max(x.h) AS h, string_agg(CASE WHEN x IS NOT NULL THEN x.b ELSE line END, chr(10) ORDER BY line_no) AS body FROM k WHERE line_start IS NOT NULL GROUP BY 1, 2)"""
_HOUR = "CASE WHEN h = 'PM' AND hh <> 12 THEN hh + 12 WHEN h = 'AM' AND hh = 12 THEN 0 ELSE hh END"
#: The order of day and month of each export, by its first twenty dated lines and its language.
FORMATS = r"""dl AS (SELECT source_zip, line_no, CAST(regexp_extract(line, '^\[?(\d{1,2})/(\d{1,2})/\d{2,4}', 1) AS INT) AS a, CAST(regexp_extract(line, '^\[?(\d{1,2})/(\d{1,2})/\d{2,4}', 2) AS INT) AS b FROM l WHERE regexp_matches(line, '^\[?\d{1,2}/\d{1,2}/\d{2,4}')),
dv AS (SELECT source_zip, max(a) AS a, max(b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY source_zip ORDER BY line_no) AS r FROM dl) WHERE r <= 20 GROUP BY 1),
dg AS (SELECT source_zip, coalesce(arg_min(g, line_no) FILTER (g IS NOT NULL), 'en') AS g FROM (SELECT source_zip, line_no, CASE WHEN line_no > 5 THEN NULL WHEN contains(lower(line), 'criptografia de ponta a ponta') THEN 'pt-br' WHEN contains(lower(line), 'end-to-end encrypted') THEN 'en' WHEN contains(lower(line), 'conversa do whatsapp') THEN 'pt-br' END AS g FROM l) GROUP BY 1),
fm AS (SELECT source_zip, CASE WHEN a > 12 THEN 'DD/MM' WHEN b > 12 THEN 'MM/DD' WHEN g = 'pt-br' THEN 'DD/MM' ELSE 'MM/DD' END AS date_format FROM dg LEFT JOIN dv USING (source_zip))"""
_FIRST_LINES = "regexp_replace(body, '^[^:]+:[\\s\\x{feff}\\x{a0}]*', '')"
#: Typed messages of the log: source_zip, pos, line_start, line_end, timestamp, sender, content, kind, subtype, media_file, omitted, edited.
MESSAGES = f"""{BLOCKS}, {FORMATS},
f0 AS (SELECT b.*, date_format, string_split(d, '/') AS ds, string_split(t, ':') AS tp, strpos(body, ': ') AS cp FROM b JOIN fm USING (source_zip)),
f1 AS (SELECT *, CAST(tp[1] AS INT) AS hh, CASE WHEN date_format = 'DD/MM' THEN ds[2] ELSE ds[1] END AS mo, CASE WHEN date_format = 'DD/MM' THEN ds[1] ELSE ds[2] END AS da, CASE WHEN length(ds[3]) = 2 THEN '20' || ds[3] ELSE ds[3] END AS yr,
  (cp = 0 AND NOT (ends_with(body, ':') OR contains(body, ':' || chr(10)))) OR ({has_any('lower(body)', SYSTEM)} AND cp > 51) AS sys FROM f0),
f2 AS (SELECT source_zip, line_start, line_end, body, sys, yr || '-' || lpad(mo, 2, '0') || '-' || lpad(da, 2, '0') || 'T' || lpad(CAST({_HOUR} AS VARCHAR), 2, '0') || ':' || tp[2] || ':' || coalesce(tp[3], '00') AS timestamp,
  CASE WHEN sys THEN '' WHEN cp > 0 THEN substr(body, 1, cp - 1) ELSE substr(body, 1, strpos(body, ':') - 1) END AS sender,
  CASE WHEN sys THEN body WHEN cp > 0 THEN substr(body, cp + 2) ELSE regexp_replace(substr(body, strpos(body, ':') + 1), '^[{WS}]+', '') END AS raw FROM f1),
f3 AS (SELECT *, {content_rules('raw')} AS c FROM f2),
f4 AS (SELECT *, CASE WHEN c.file IS NOT NULL AND contains(body, chr(10)) THEN (SELECT regexp_replace(array_to_string(list_filter(ls, lambda v, i: NOT (i > 1 AND regexp_matches(coalesce(ls[i - 1], ''), '{ATTACHED}') AND {trim('v')} = c.file)), chr(10)), '^[^:]+:[\\t\\n\\f\\r \\x0b\\x{{feff}}\\x{{a0}}]*', '') FROM (SELECT string_split(body, chr(10)) AS ls)) END AS again FROM f3),
f5 AS (SELECT *, CASE WHEN again IS NOT NULL THEN {content_rules('again')} END AS e FROM f4),
f6 AS (SELECT *, CASE WHEN NOT sys THEN coalesce(e.file, c.file) END AS media_file FROM f5),
msg AS (SELECT source_zip, row_number() OVER (PARTITION BY source_zip ORDER BY line_start) AS pos, line_start, line_end, timestamp, sender, CASE WHEN sys THEN body ELSE coalesce(e.content, c.content) END AS content,
  CASE WHEN sys THEN 'system' WHEN c.file IS NOT NULL AND coalesce(e.kind, c.kind) = 'text' THEN 'media' ELSE coalesce(e.kind, c.kind) END AS kind,
  CASE WHEN sys THEN {system_kind('body')} WHEN media_file IS NOT NULL THEN {media_kind("lower(list_last(string_split(media_file, '.')))")} END AS subtype, media_file, NOT sys AND coalesce(e.omitted, c.omitted) AS omitted, NOT sys AND (c.edited OR coalesce(e.edited, false)) AS edited FROM f6)"""
#: The ordered merge of late archives into the early index, message by message: a recursive walk of each (timestamp, sender).
MERGE = r"""m0 AS (SELECT message_id, contact, seq, timestamp, coalesce(sender, '') AS sender, media_file IS NOT NULL AS md, type = 'media' AND media_file IS NULL AS om, source_zip, regexp_matches(source_zip, '\(\d+\)\.zip$') AS late FROM messages WHERE message_id IS NOT NULL AND contact IS NOT NULL),
m1 AS (SELECT *, max({'t': timestamp, 's': sender}) OVER (PARTITION BY contact, message_id) AS key FROM m0),
zo AS (SELECT source_zip, min(zip_order) AS z FROM archives GROUP BY 1),
new AS (SELECT *, key.t AS t, key.s AS s, coalesce(z, 0) AS ar, row_number() OVER (PARTITION BY contact, coalesce(z, 0) ORDER BY seq, message_id, source_zip) AS slot FROM m1 LEFT JOIN zo USING (source_zip) WHERE late),
g AS (SELECT *, row_number() OVER (PARTITION BY t, s ORDER BY ar, contact, slot) AS n FROM new),
ix AS (SELECT * FROM (SELECT *, key.t AS t, key.s AS s, row_number() OVER (PARTITION BY contact, message_id ORDER BY seq, source_zip) AS r FROM m1 WHERE NOT late) WHERE r = 1),
old AS (SELECT t, s, list({'c': contact, 'id': message_id, 'm': md, 'o': om, 'n': CAST(NULL AS BIGINT), 'at': CAST(NULL AS BIGINT), 'q': seq} ORDER BY contact, seq) AS st FROM ix GROUP BY 1, 2),
f(t, s, n, st, ids, cur, now, ev) AS (
 SELECT t, s, CAST(0 AS BIGINT), coalesce(st, []), list_transform(coalesce(st, []), lambda x: x.id), CAST(NULL AS STRUCT(c VARCHAR, id VARCHAR, m BOOLEAN, o BOOLEAN, n BIGINT, "at" BIGINT, q BIGINT)), CAST(NULL AS VARCHAR), CAST([] AS STRUCT(n BIGINT, act VARCHAR, "at" BIGINT, q BIGINT, c VARCHAR)[]) FROM (SELECT DISTINCT t, s FROM g) LEFT JOIN old USING (t, s)
 UNION ALL
 SELECT t, s, n, CASE act WHEN 'skipped' THEN st ELSE list_append(list_filter(st, lambda x: act = 'added' OR x.id <> cu.id OR x.c <> cu.c), me) END,
  CASE act WHEN 'skipped' THEN ids WHEN 'added' THEN list_append(ids, id) ELSE list_append(list_filter(ids, lambda x: x <> cu.id), id) END, CASE act WHEN 'skipped' THEN cu ELSE me END, here,
  ev || CASE WHEN act <> 'upgraded' THEN [{'n': n, 'act': act, 'at': me."at", 'q': me.q, 'c': c}] ELSE [{'n': cu.n, 'act': CASE WHEN cu.n IS NULL THEN 'deleted' ELSE 'replaced' END, 'at': CAST(NULL AS BIGINT), 'q': cu.q, 'c': c}, {'n': n, 'act': act, 'at': me."at", 'q': me.q, 'c': c}] END
 FROM (SELECT *, CASE act WHEN 'upgraded' THEN {'c': c, 'id': id, 'm': md, 'o': om, 'n': n, 'at': cu."at", 'q': cu.q} ELSE {'c': c, 'id': id, 'm': md, 'o': om, 'n': n, 'at': n, 'q': CAST(NULL AS BIGINT)} END AS me
  FROM (SELECT *, CASE WHEN list_contains(ids, id) THEN 'skipped' WHEN md AND cu IS NOT NULL AND NOT cu.m THEN 'upgraded' WHEN om AND cu IS NOT NULL AND cu.m THEN 'skipped' ELSE 'added' END AS act
   FROM (SELECT f.t, f.s, g.n, st, ids, ev, g.message_id AS id, g.contact AS c, g.md, g.om, g.contact || chr(0) || g.ar AS here,
     CASE WHEN now = g.contact || chr(0) || g.ar THEN cur ELSE coalesce(list_filter(st, lambda x: x.c = g.contact AND x.m)[1], list_filter(st, lambda x: x.c = g.contact)[-1]) END AS cu
    FROM f JOIN g ON g.t = f.t AND g.s = f.s AND g.n = f.n + 1)))),
ev AS (SELECT t, s, unnest(ev) AS e FROM (SELECT t, s, arg_max(ev, n) AS ev FROM f GROUP BY 1, 2)),
ev2 AS (SELECT t, s, e.c AS contact, e.n AS n, e.act AS action, e."at" AS at_n, e.q AS q FROM ev),
gone AS (SELECT t, s, n FROM ev2 WHERE action = 'replaced'),
ev3 AS (SELECT * FROM ev2 WHERE action NOT IN ('added', 'upgraded') OR NOT EXISTS (SELECT 1 FROM gone WHERE gone.t = ev2.t AND gone.s = ev2.s AND gone.n = ev2.n)),
top AS (SELECT contact, max(seq) AS top FROM ix GROUP BY 1),
pl AS (SELECT p.t, p.s, p.at_n, coalesce(top, 0) + row_number() OVER (PARTITION BY g.contact ORDER BY g.ar, g.slot) AS place FROM (SELECT DISTINCT t, s, at_n FROM ev3 WHERE at_n IS NOT NULL AND action IN ('added', 'upgraded')) p JOIN g ON g.t = p.t AND g.s = p.s AND g.n = p.at_n LEFT JOIN top ON top.contact = g.contact),
acts AS (SELECT ev3.contact, CAST(g.ar AS INTEGER) AS archive, action, g.slot AS pos, coalesce(q, place) AS seq, g.message_id AS id FROM ev3 LEFT JOIN g ON g.t = ev3.t AND g.s = ev3.s AND g.n = ev3.n LEFT JOIN pl ON pl.t = ev3.t AND pl.s = ev3.s AND pl.at_n = ev3.at_n)"""
#: First occurrences and media variants within an archive, message by message; a slot is filled once.
DEDUP = r"""d0 AS (SELECT row_id, coalesce(source_zip, chr(1)) AS z, coalesce(timestamp, chr(1)) AS t, coalesce(sender, chr(1)) AS s, media_file IS NOT NULL AS md, coalesce(is_media_omitted, false) AS om, sha256(coalesce(timestamp, '') || chr(0) || coalesce(sender, '') || chr(0) || coalesce(content, '') || chr(0) || coalesce(media_file, '')) AS id FROM parsed),
d1 AS (SELECT *, row_number() OVER (PARTITION BY z, t, s ORDER BY row_id) AS n FROM d0),
w(z, t, s, n, seen, outs, slot) AS (
 SELECT DISTINCT z, t, s, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(p BIGINT, r BIGINT, id VARCHAR, m BOOLEAN)[]), CAST(NULL AS BIGINT) FROM d1
 UNION ALL
 SELECT z, t, s, n, CASE act WHEN 0 THEN seen WHEN 2 THEN list_append(list_filter(seen, lambda x: x <> outs[slot].id), id) ELSE list_append(seen, id) END,
  CASE act WHEN 0 THEN outs WHEN 2 THEN list_transform(outs, lambda x, i: CASE WHEN i = slot THEN {'p': x.p, 'r': row_id, 'id': id, 'm': md} ELSE x END) ELSE list_append(outs, {'p': row_id, 'r': row_id, 'id': id, 'm': md}) END,
  CASE WHEN act = 2 THEN NULL WHEN act = 1 AND om THEN len(outs) + 1 ELSE slot END
 FROM (SELECT w.z, w.t, w.s, d1.n, seen, outs, slot, id, md, om, row_id, CASE WHEN list_contains(seen, id) THEN 0 WHEN om AND len(list_filter(outs, lambda x: x.m)) > 0 THEN 0 WHEN NOT om AND md AND slot IS NOT NULL THEN 2 ELSE 1 END AS act FROM w JOIN d1 ON d1.z = w.z AND d1.t = w.t AND d1.s = w.s AND d1.n = w.n + 1)),
kept AS (SELECT z, unnest(outs) AS o FROM (SELECT z, t, s, arg_max(outs, n) AS outs FROM w GROUP BY 1, 2, 3))"""
