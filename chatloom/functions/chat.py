"""Scalar functions of the chat parser and its names, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import WS, js_trim, remove_first

# Phrases and patterns the export format uses.
DELETED = ["Esta mensagem foi apagada", "Você apagou esta mensagem", "This message was deleted", "You deleted this message"]
EDITED = ["<This message was edited>", "(editada)", "(edited)"]
OMITTED = ["<Media omitted>", "<Mídia oculta>"]
ENCRYPTION = ["end-to-end encrypted", "criptografia de ponta a ponta", "protegidas com a criptografia"]
CALL = ["chamada de voz", "chamada de vídeo", "missed voice call", "missed video call", "voice call", "video call"]
MEMBERSHIP = ["added you", "added", "removed", "left", "adicionou você", "adicionou", "removeu", "saiu"]
ADMIN = ["created group", "criou o grupo", "changed the subject", "alterou o assunto", "changed the group description", "changed this group's icon", "changed the group's"]
GROUP_SIGNS = ["created group", "criou o grupo", "added you", "adicionou você"]
ATTACHED = r"^([^\n\r  ]+)[" + WS + r"]\((?:file attached|arquivo anexado)\)\z"
DATE = r"(\d{1,2}/\d{1,2}/\d{2,4})"
TIME = r"(\d{1,2}:\d{2}(?::\d{2})?)"
BRACKETED = rf"^\[{DATE},?[{WS}]{TIME}\][{WS}]([^\n\r  ]*)\z"
DASHED = rf"^\[?{DATE},?[{WS}]{TIME}(?:[{WS}]([AP]M))?\]?[{WS}][-–][{WS}]([^\n\r  ]*)\z"
EXTENSIONS = {"audio": ["opus", "ogg", "oga", "m4a"], "image": ["jpg", "jpeg", "png"], "video": ["mp4", "3gp"], "sticker": ["webp"], "contact": ["vcf"]}
AUDIO_INPUTS = ["opus", "mp4", "m4a", "mp3", "ogg", "oga"]
IMAGE_INPUTS = ["jpg", "jpeg"]
MIME = {"m4a": "audio/x-m4a", "mp3": "audio/mpeg", "mp4": "video/mp4", "opus": "audio/opus", "ogg": "audio/ogg", "oga": "audio/ogg"}


def _any(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def start_parts(line: Column) -> Column:
    """Array [form, date, time, half (AM/PM), body] of a message's first line, null for any other.

    The bracketed form is tried first. One replacement into a fixed layout per form keeps it to one
    pass over the line; put it into a column of its own before taking fields from it.
    """
    may = line.rlike(r"^\[?\d")
    made = F.when(line.rlike(BRACKETED), F.regexp_replace(line, BRACKETED, "b|$1|$2||$3")).when(line.rlike(DASHED), F.regexp_replace(line, DASHED, "d|$1|$2|$3|$4"))
    return F.split(F.when(may, made), r"\|", 5)


def start_fields(parts: Column) -> dict[str, Column]:
    """is_start, date, time, half and body of a column made by start_parts."""
    at = lambda i: F.get(parts, F.lit(i))
    return {"is_start": parts.isNotNull(), "date": at(1), "time": at(2), "half": at(3), "body": at(4)}


def resolve_timestamp(date: Column, time: Column, half: Column, fmt: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS without any check of ranges; the text identifies messages."""
    d, t = F.split(date, "/"), F.split(time, ":")
    day_first = fmt == "DD/MM"
    month, day = F.when(day_first, F.get(d, F.lit(1))).otherwise(F.get(d, F.lit(0))), F.when(day_first, F.get(d, F.lit(0))).otherwise(F.get(d, F.lit(1)))
    year = F.get(d, F.lit(2))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    hour = F.get(t, F.lit(0)).cast("int")
    hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    second = F.coalesce(F.get(t, F.lit(2)), F.lit("00"))
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.get(t, F.lit(1)), F.lit(":"), second)


def is_system(body: Column) -> Column:
    return _any(F.lower(body), [*ENCRYPTION, *CALL, *ADMIN, *MEMBERSHIP])


def system_subtype(content: Column) -> Column:
    low = F.lower(content)
    return F.when(_any(low, ENCRYPTION), "encryption").when(_any(low, CALL), "call").when(_any(low, ADMIN), "admin").when(_any(low, MEMBERSHIP), "membership").otherwise("other")


def split_body(body: Column) -> dict[str, Column]:
    """sender, raw and system: the sender ends at the first ": " of the whole body, else at a colon
    that ends the body or a line; without either, and for long system texts, there is none."""
    at = F.instr(body, ": ")
    alone = (at == 0) & (body.endswith(":") | body.contains(":\n"))
    colon = F.instr(body, ":")
    system = ((at == 0) & ~alone) | (is_system(body) & (at > 51))
    sender = F.when(system, "").when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(F.substring(body, F.lit(1), colon - 1))
    rest = F.regexp_replace(F.substring(body, colon + 1, F.length(body)), rf"^[{WS}]+", "")
    raw = F.when(system, body).when(at > 0, F.substring(body, at + 2, F.length(body))).otherwise(rest)
    return {"sender": sender, "raw": raw, "system": system}


def media_subtype(filename: Column) -> Column:
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    out = F.lit("document")
    for kind, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), kind).otherwise(out)
    return F.when(filename.isNotNull(), out)


def content_rules(df: DataFrame, raw: Column, out: str) -> DataFrame:
    """df with ``out``: struct(type, content, edited, omitted, media_file) by the rules deleted,
    edited, omitted, attached, text, in that order.

    Each rule is a step of its own: one nested expression would repeat its inputs at every use.
    """
    p = f"__{out}_"
    df = df.withColumn(f"{p}raw", raw).withColumn(f"{p}trim", js_trim(F.col(f"{p}raw"))).withColumn(f"{p}text", F.col(f"{p}raw"))
    edited = _any(F.col(f"{p}raw"), EDITED)
    for marker in EDITED:
        text = F.col(f"{p}text")
        df = df.withColumn(f"{p}text", F.when(text.contains(marker), js_trim(remove_first(text, marker))).otherwise(text))
    text, gone = F.col(f"{p}text"), F.col(f"{p}trim").isin(DELETED)
    omitted = _any(text, OMITTED)
    rest = F.when(text.contains(OMITTED[0]), remove_first(text, OMITTED[0])).otherwise(remove_first(text, OMITTED[1]))
    df = df.withColumns({f"{p}lines": F.split(text, "\n"), f"{p}rest": F.when(omitted, js_trim(rest))})
    lines = F.col(f"{p}lines")
    first = F.get(lines, F.lit(0))
    df = df.withColumn(f"{p}name", F.when(first.rlike(ATTACHED), js_trim(F.regexp_extract(first, ATTACHED, 1))))
    name, rest = F.col(f"{p}name"), F.col(f"{p}rest")
    echo = F.coalesce(js_trim(F.get(lines, F.lit(1))) == name, F.lit(False))
    tail = F.slice(lines, F.when(echo, 3).otherwise(2), F.greatest(F.size(lines), F.lit(1)))
    made = F.struct(
        F.when(gone, "deleted").when(rest.isNotNull() | name.isNotNull(), "media").otherwise("text").alias("type"),
        F.when(gone, F.col(f"{p}trim")).when(rest.isNotNull(), rest).when(name.isNotNull(), js_trim(F.array_join(tail, "\n"))).otherwise(text).alias("content"),
        (~gone & edited).alias("edited"),
        (~gone & rest.isNotNull()).alias("omitted"),
        F.when(~gone & rest.isNull(), name).alias("media_file"),
    )
    return df.withColumn(out, made).drop(*[f"{p}{x}" for x in ("raw", "trim", "text", "lines", "rest", "name")])


def without_echo(body: Column, media_file: Column) -> Column:
    """The body without lines that only repeat the file's name after an attachment line."""
    lines = F.split(body, "\n")
    # filter with an index cannot look back by itself; the pairs carry the line before
    pairs = F.arrays_zip(lines.alias("x"), F.concat(F.array(F.lit("")), lines).alias("before"))
    keep = F.filter(pairs, lambda p: p["x"].isNotNull() & ~(p["before"].rlike(ATTACHED) & (js_trim(p["x"]) == media_file)))
    return F.array_join(F.transform(keep, lambda p: p["x"]), "\n")


def zip_language(name: Column) -> Column:
    return F.when(name.rlike("(?i)Conversa do WhatsApp"), "pt-br").otherwise("en")


def contact_from_zip(name: Column) -> Column:
    """The chat's name in an archive's file name, by four ordered rules."""
    base = F.element_at(F.split(name, "/"), -1)
    get = lambda p: F.nullif(F.regexp_extract(base, p, 1), F.lit(""))
    return F.coalesce(get(r"(?i)^WhatsApp Chat with (.+?)\.zip\z"), get(r"(?i)^WhatsApp Chat with (.+)\z"), get(r"(?i)^Conversa do WhatsApp com (.+?)\.zip\z"), F.regexp_replace(base, r"(?i)\.zip\z", ""))


def sanitize_name(name: Column) -> Column:
    """A name safe for file systems, at most 200 code points."""
    t = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), "_+", "_")
    t = F.regexp_replace(t, rf"^[.{WS}]+|[.{WS}]+\z", "")
    return F.left(F.regexp_replace(t, r"_+\z", ""), F.lit(200))


def display_sender(sender: Column, aliases: Column, is_group: Column, self_name: Column) -> Column:
    """Alias first; then Eu for the account owner in chats of two."""
    named = F.coalesce(F.try_element_at(aliases, sender), sender)
    return F.when(~is_group & self_name.isNotNull() & (self_name != "") & (named == self_name), "Eu").otherwise(named)


def message_id(timestamp: Column, sender: Column, content: Column, media_file: Column) -> Column:
    z = F.lit("\0")
    return F.sha2(F.concat(timestamp, z, sender, z, content, z, F.coalesce(media_file, F.lit(""))), 256)


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("application/octet-stream"))


def sidecar_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]+\z", ".md")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clock(seconds: Column) -> Column:
    """MM:SS.cc, all rounded down; minutes go on beyond 59; --:-- without a time."""
    part = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    mins = F.floor(seconds / 60).cast("string")
    mins = F.when(F.length(mins) < 2, F.lpad(mins, 2, "0")).otherwise(mins)
    return F.coalesce(F.concat(mins, F.lit(":"), part(seconds % 60), F.lit("."), part((seconds % 1) * 100)), F.lit("--:--"))


def iso_time(ts: Column) -> Column:
    """UTC with milliseconds, as in 2026-01-16T10:09:00.000Z (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_and_time(ts: Column) -> Column:
    """16/01/2026 às 10:09:00."""
    return F.date_format(ts, "dd/MM/yyyy 'às' HH:mm:ss")


def percent(p: Column) -> Column:
    """A probability in percent with one decimal; ties go up."""
    return F.format_string("%.1f%%", p * 100)


def image_payload(content: Column) -> Column:
    """Bytes as one line of base64."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")
