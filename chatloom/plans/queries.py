"""The queries of the driver contract that need no text-training operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.functions.periods import day_header, lenient_date, period_bounds, period_boundaries, period_label
from chatloom.functions.text import js_trim
from chatloom.operators import dedup, media, parser, render, store
from chatloom.operators.ordering import changes, islands, number_rows
from chatloom.operators.timestamps import normalize_timestamps
from chatloom.plans.oracles import ORACLES
from chatloom.schemas import MEDIA, SPLITS
from chatloom.session import cut, read, small

Query = Callable[[SparkSession, str], DataFrame]
SLICE = 8192
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines written from all rows of parsed: both line forms with their variants, both orders of
    day and month (by export), attachments with and without echo, omitted media, deleted and system
    messages. Contents keep their line ends of every kind, so some lines start no message."""
    r = F.col("row_id")
    day, month, year = 1 + r % 28, 1 + r % 12, 2024 + r % 3
    day_first = F.length("source_zip") % 2 == 0
    a, b = F.when(day_first, day).otherwise(month), F.when(day_first, month).otherwise(day)
    h, m, s = r % 24, r % 60, F.floor(r / 7) % 60
    half = F.when(h < 12, "AM").otherwise("PM")
    stamp = (
        F.when(r % 4 == 0, F.format_string("%d/%d/%02d, %02d:%02d - ", a, b, year % 100, h, m))
        .when(r % 4 == 1, F.format_string("[%02d/%02d/%d, %02d:%02d:%02d] ", a, b, year, h, m, s))
        .when(r % 4 == 2, F.format_string("%d/%d/%02d, %d:%02d%s%s - ", a, b, year % 100, (h + 11) % 12 + 1, m, F.when(r % 8 == 2, " ").otherwise("\u202f"), half))
        .otherwise(F.format_string("%d/%d/%d %02d:%02d:%02d – ", a, b, year, h, m, s))
    )
    content = F.coalesce("content", F.lit(""))
    caption = F.when(content != "", F.concat(F.lit("\n"), content)).otherwise("")
    attached = F.concat("media_file", F.when(r % 2 == 0, " (file attached)").otherwise(" (arquivo anexado)"), F.when(r % 3 == 0, F.concat(F.lit("\n"), "media_file")).otherwise(""), caption)
    omitted = F.concat(F.when(r % 2 == 0, "<Media omitted>").otherwise("<Mídia oculta>"), caption)
    said = F.when(F.col("media_file").isNotNull(), attached).when(F.coalesce("is_media_omitted", F.lit(False)), omitted).otherwise(content)
    body = F.when(F.coalesce("sender", F.lit("")) == "", content).otherwise(F.concat("sender", F.lit(": "), said))
    rows = read(spark, d, "parsed").select("source_zip", "pos", "row_id", F.posexplode(F.split(F.concat(stamp, body), "\n")).alias("i", "line"))
    rows = number_rows(rows, ["source_zip"], F.floor(F.col("pos") / SLICE), ["pos", "row_id", "i"], "line_no")
    return rows.select("source_zip", F.col("line_no").cast("int").alias("line_no"), "line")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    times = normalize_timestamps(read(spark, d, "parsed").select("row_id", "source_zip", "timestamp"), read(spark, d, "ingest_options"))
    return times.select("row_id", "utc_sec").filter("utc_sec is not null")


@query
def flagship_sender_weeks(spark: SparkSession, d: str) -> DataFrame:
    rows = parser.parse_lines(cut(_lines(spark, d)))
    return rows.groupBy("sender", period_label(lenient_date(F.col("timestamp")), "1w").alias("period")).agg(F.count("*").alias("messages"))


@query
def parse_chat_log(spark: SparkSession, d: str) -> DataFrame:
    rows = parser.parse_lines(cut(_lines(spark, d)))
    return rows.select("source_zip", "pos", "line_start", "line_end", "timestamp", "sender", "content", "type", "subtype", "media_file", "is_media_omitted", "edited")


@query
def detect_date_format(spark: SparkSession, d: str) -> DataFrame:
    return parser.detect_formats(_lines(spark, d)).select("source_zip", "date_format")


@query
def start_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    p = chat.start_fields(F.col("m"))
    return rows.withColumn("m", chat.start_parts(F.col("line"))).filter("m is not null").select("doc_id", F.col("i").cast("long").alias("line_no"), p["date"].alias("d"), p["time"].alias("t"), p["body"].alias("body"))


@query
def parse_warnings(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("source_zip"), "text")
    return parser.warnings(parser.log_lines(docs, drop_last_empty=False)).groupBy("source_zip").agg(F.count("*").alias("warnings"))


@query
def split_sender(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed").filter("content is not null")
    s = chat.split_body(F.col("content"))
    return p.select("row_id", s["sender"].alias("sender"), s["raw"].alias("raw"), s["system"].alias("system"))


@query
def content_rules(spark: SparkSession, d: str) -> DataFrame:
    c = chat.content_rules(read(spark, d, "parsed").select("row_id", "content"), F.coalesce("content", F.lit("")), "c")
    return c.select("row_id", "c.type", "c.content", "c.edited", "c.omitted")


@query
def system_subtype(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed").filter("content is not null")
    return p.select("row_id", chat.system_subtype(F.col("content")).alias("kind"), chat.is_system(F.col("content")).alias("is_system"))


@query
def media_kind(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "parsed").filter("media_file is not null")
    ext = F.lower(F.element_at(F.split("media_file", r"\."), -1))
    return m.select(
        "row_id", chat.media_subtype(F.col("media_file")).alias("kind"), chat.mime_type(F.col("media_file")).alias("mime"), ext.isin(chat.AUDIO_INPUTS).alias("is_audio"),
        ext.isin(chat.IMAGE_INPUTS).alias("is_image"), chat.sidecar_path(F.col("media_file")).alias("sidecar"),
    )


@query
def message_id(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed")
    return dedup.with_id(p).select("row_id", "message_id")


@query
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    p = dedup.with_id(read(spark, d, "parsed"))
    return dedup.first_occurrence(p, ["source_zip", "message_id"], ["pos", "row_id"]).select("row_id")


@query
def dedup_media_variant(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed").drop("pos").withColumnRenamed("row_id", "pos")
    return dedup.dedup_archive(p, "omitted_only").select(F.col("pos").alias("row_id"), "slot")


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, new, acts): the late archives of messages (those with a copy number) merged one after
    the other, in archive order, into the index of the early ones; all contacts."""
    m = read(spark, d, "messages").filter("message_id is not null and contact is not null").select(
        "message_id", "contact", "seq", "timestamp", F.coalesce("sender", F.lit("")).alias("sender"), "media_file", "source_zip", ((F.col("type") == "media") & F.col("media_file").isNull()).alias("is_media_omitted")
    )
    # copies of one id may spell stamp or sender differently; they are one message and fold together
    key = F.struct("timestamp", "sender")
    same = cut(m.groupBy("contact", "message_id").agg(F.max(key).alias("key"), F.min(key).alias("other")).filter("key != other").drop("other"))
    m = cut(m.join(small(same), ["contact", "message_id"], "left").withColumns({c: F.coalesce(f"key.{c}", c) for c in ("timestamp", "sender")}).drop("key"))
    late = F.col("source_zip").rlike(r"\(\d+\)\.zip$")
    order = read(spark, d, "archives").groupBy("source_zip").agg(F.min("zip_order").alias("archive"))
    new = m.filter(late).join(small(order), "source_zip", "left").withColumn("archive", F.coalesce("archive", F.lit(0)))
    new = cut(number_rows(new, ["contact", "archive"], F.floor(F.col("seq") / SLICE), ["seq", "message_id", "source_zip"], "slot"))
    index = dedup.first_occurrence(m.filter(~late), ["contact", "message_id"], ["seq", "source_zip"])
    return index, new, cut(store.merge_archives(index, new))


@query
def merge_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The index after the merge."""
    index, new, acts = _merge(spark, d)
    return store.apply_merge(index.drop("source_zip"), new.drop("seq", "source_zip"), acts).select("contact", "message_id", "seq")


@query
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    acts = _merge(spark, d)[2]
    return acts.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "skipped", "upgraded", "replaced", "deleted")])


@query
def merge_upsert_media(spark: SparkSession, d: str) -> DataFrame:
    """What happens to each late row; pos is its place among its contact's rows of its archive."""
    return _merge(spark, d)[2].select("contact", "archive", "action", "pos", "seq")


def _period_query(interval: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = read(spark, d, "messages")
        return m.groupBy(period_label(lenient_date(F.col("timestamp")), interval).alias("label")).agg(F.count("*").alias("n"))

    return run


for _split in SPLITS:
    _QUERIES[f"period_{_split}"] = _period_query(_split)


@query
def period_boundaries_1w(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "messages").groupBy("contact").agg(F.min(lenient_date(F.col("timestamp"))).alias("a"), F.max(lenient_date(F.col("timestamp"))).alias("b"))
    return m.select("contact", F.explode(period_boundaries(F.col("a"), F.col("b"), "1w")).alias("label"))


@query
def order_quarters(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    start, end = period_bounds(o["o_orderdate"].cast("date"), "3mo")
    return o.groupBy(start.cast("string").alias("q_start"), end.cast("string").alias("q_end")).agg(F.count("*").alias("n"))


@query
def contact_periods(spark: SparkSession, d: str) -> DataFrame:
    return store.contact_periods(read(spark, d, "messages"))


@query
def contact_message_count(spark: SparkSession, d: str) -> DataFrame:
    return store.contact_counts(read(spark, d, "messages"))


@query
def day_headers(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "messages").filter("contact is not null")
    rows = changes(m, ["contact", "period"], F.floor(F.col("seq") / SLICE), ["seq", "message_id", "source_zip"], F.substring("timestamp", 6, 5), "new_day")
    return rows.filter("new_day").select("contact", "period", "seq", day_header(lenient_date(F.col("timestamp"))).alias("header"))


@query
def detect_self(spark: SparkSession, d: str) -> DataFrame:
    """For each owner of exports the sender present in all contacts of their exports."""
    m = read(spark, d, "messages").select("source_zip", "contact", "sender")
    o = read(spark, d, "ingest_options").select("source_zip", F.col("self").alias("owner")).filter("owner is not null").distinct()
    return store.detect_self(m.join(o, "source_zip").select("owner", "contact", "sender"), "owner")


@query
def group_test(spark: SparkSession, d: str) -> DataFrame:
    return store.group_test(read(spark, d, "parsed"))


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids and contacts of the accepted history, rows of later batches, archives of those)."""
    p = dedup.with_id(read(spark, d, "parsed")).select("source_zip", "message_id", "batch_no", F.col("row_id").alias("slot"))
    a = read(spark, d, "archives").select("source_zip", "zip_order", "contact_name")
    old = p.filter("batch_no = 0").join(a, "source_zip").select("message_id", F.col("contact_name").alias("contact")).distinct()
    new = p.filter("batch_no > 0")
    return old, new, a.join(new.select("source_zip").distinct(), "source_zip", "left_semi")


@query
def overlap_votes(spark: SparkSession, d: str) -> DataFrame:
    return store.overlap_votes(*_history(spark, d))


@query
def overlap_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The contact each later archive's messages go to, given the accepted history."""
    went = store.resolve_contacts(*_history(spark, d))
    return spark.createDataFrame(list(went.items()), "source_zip string, contact string")


@query
def latest_meta(spark: SparkSession, d: str) -> DataFrame:
    m = store.latest_meta(read(spark, d, "archives"))
    return m.select("contact_name", "date_format", "encoding", F.size("source_zips").cast("long").alias("archives"))


@query
def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contacts").filter("contact is not null")
    return c.select("contact", chat.sanitize_name(F.concat(F.lit(" ..a/b:"), "contact", F.lit("?*._ "))).alias("safe"))


@query
def contact_from_zip(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "archives")
    return a.select("source_zip", chat.contact_from_zip(F.concat(F.lit("in/"), "source_zip")).alias("contact"), chat.zip_language(F.col("source_zip")).alias("language"))


@query
def alias_display_sender(spark: SparkSession, d: str) -> DataFrame:
    """Names as shown, with an alias for the owner of each export."""
    m = read(spark, d, "messages").join(read(spark, d, "contacts").select("contact", (F.col("type") == "group").alias("g")), "contact")
    o = read(spark, d, "ingest_options").select("source_zip", "self").distinct()
    m = m.join(o, "source_zip", "left")
    table = F.when(F.col("self").isNotNull(), F.create_map("self", F.upper("self"))).otherwise(F.create_map(F.lit(""), F.lit("")))
    shown = chat.display_sender(F.coalesce("sender", F.lit("")), table, F.col("g"), F.upper("self"))
    return m.groupBy("contact", shown.alias("shown")).agg(F.count("*").alias("n"))


def _media(spark: SparkSession, d: str) -> DataFrame:
    """The media table of all archives, processed with the offline models."""
    a = read(spark, d, "archives")
    entries = a.select(F.col("contact_name").alias("contact"), "source_zip", "zip_order", F.explode("media_files").alias("filename")).withColumn("stored_name", F.col("filename"))
    known = store.register_media(spark.createDataFrame([], MEDIA), entries)
    key = F.to_json(F.struct("contact", "filename"))
    items = cut(known.select("contact", "filename", "status", key.alias("key"), F.col("stored_name").alias("path")))
    # as many tasks as the session shuffles into; the stubs call nothing that wants sparing
    got = media.process_media(items, "all", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return store.update_media(known, got.join(items.select("key", "contact", "filename"), "key"))


@query
def ingest_media(spark: SparkSession, d: str) -> DataFrame:
    return _media(spark, d).select("contact", "filename", "status", "type", "source_zip", "transcription")


@query
def media_left_join(spark: SparkSession, d: str) -> DataFrame:
    m = store.attach_media(read(spark, d, "messages").filter("media_file is not null"), _media(spark, d))
    return m.groupBy("contact").agg(F.count("*").alias("n"), F.count_if("media_exists").alias("present"), F.count("transcription").alias("transcribed"))


@query
def media_registration(spark: SparkSession, d: str) -> DataFrame:
    """Files that messages name, registered beside those the archives hold."""
    a = read(spark, d, "archives")
    entries = lambda x, f: x.select(F.col("contact_name").alias("contact"), "source_zip", "zip_order", f.alias("filename")).withColumn("stored_name", F.col("filename"))
    known = store.register_media(spark.createDataFrame([], MEDIA), entries(a, F.explode("media_files"))).withColumn("status", F.lit("processed"))
    named = read(spark, d, "messages").filter("media_file is not null").join(a.select("source_zip", "zip_order"), "source_zip").withColumnRenamed("contact", "contact_name")
    return store.register_media(cut(known), entries(named, F.col("media_file"))).select("contact", "filename", "status", "type", "source_zip")


@query
def media_placement(spark: SparkSession, d: str) -> DataFrame:
    from chatloom.sources.archives import media_placement as place

    staged = read(spark, d, "archives").select(F.col("contact_name").alias("contact"), F.explode("media_files").alias("media_file"))
    return place(read(spark, d, "messages"), staged)


@query
def range_line_join(spark: SparkSession, d: str) -> DataFrame:
    """Messages and the lines of their range, joined through the message's start line."""
    lines = _lines(spark, d)
    b = parser.blocks(lines)
    got = b.select("source_zip", "line_start", F.explode(F.sequence("line_start", "line_end")).alias("line_no")).join(lines, ["source_zip", "line_no"])
    return got.groupBy("source_zip").agg(F.count("*").alias("lines"), F.countDistinct("line_start").alias("messages"))


@query
def pending_anti_join(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "archives").select("source_zip", F.explode("media_files").alias("f"))
    paths = a.select(F.concat("source_zip", F.lit("/"), "f").alias("path")).distinct()
    done = paths.filter(F.col("path").rlike(r"[02468]\.[a-z0-9]+$")).select(chat.sidecar_path(F.col("path")).alias("path"))
    from chatloom.sources.archives import pending

    return pending(paths, done)


@query
def utterance_islands(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "utterances").filter("recording_id is not null")
    name = F.coalesce("speaker", F.lit("Desconhecido"))
    rows = islands(u, ["recording_id"], F.floor(F.col("utt_id") / SLICE), ["utt_id"], name, "island")
    return rows.groupBy("recording_id", "island").agg(
        F.min_by(name, "utt_id").alias("speaker"), F.count("*").alias("n"), F.min_by("start_time", "utt_id").alias("start_time"), F.max_by("end_time", "utt_id").alias("end_time"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt_id", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ").alias("text"),
    )


@query
def format_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "utterances").select("utt_id", chat.clock(F.col("start_time")).alias("clock"))


@query
def speech_document(spark: SparkSession, d: str) -> DataFrame:
    u = utterance_islands(spark, d).select("recording_id", F.col("island").alias("utterance_no"), "speaker", "start_time", "end_time", "text")
    return render.speech_markdown(u, ["recording_id"])


@query
def audio_document(spark: SparkSession, d: str) -> DataFrame:
    """Whole speech documents of all recordings."""
    u = read(spark, d, "utterances").filter("recording_id is not null")
    files = u.groupBy("recording_id").agg(F.min("loaded_at").alias("created"), F.max("loaded_at").alias("modified"), (F.count("speaker") / F.count("*")).alias("language_probability")).withColumns({
        "file": F.concat("recording_id", F.lit(".opus")), "processed": F.col("modified"), "language_code": F.lit("por"),
    })
    docs = render.audio_documents(files, speech_document(spark, d), ["recording_id"], "offline", "aviso")
    return docs.select("recording_id", F.md5("body").alias("body_md5"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    m = dedup.first_occurrence(read(spark, d, "messages").filter("contact is not null and message_id is not null"), ["message_id"], ["contact", "seq", "source_zip", "loaded_at", "sender", "timestamp"])
    return m.withColumns({
        "content": F.concat(F.lit("m "), F.substring("message_id", 1, 6)), "transcription": F.when(F.col("subtype") == "audio", "fala"), "media_exists": F.col("seq") % 2 == 0,
        "is_media_omitted": (F.col("type") == "media") & F.col("media_file").isNull(), "sender": F.coalesce("sender", F.lit("")),
    })


@query
def render_messages(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d).select("message_id", render.message_markdown(F.col("sender")).alias("md"))


@query
def render_period_document(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "contacts").withColumn("source_zips", F.array_sort("source_zips"))
    docs = render.period_documents(_rendered(spark, d), c, F.col("sender"))
    return docs.select("contact", "period", "messages", F.concat("sanitized_name", F.lit("/"), "period", F.lit(".md")).alias("path"), F.md5("body").alias("body_md5"))


def _shot(m: DataFrame) -> Column:
    """A message of the index as a message of a screenshot."""
    kind = F.when(F.col("type") == "media", F.initcap("subtype")).when(F.col("type") == "deleted", "Deleted").otherwise("Text")
    return F.struct(
        F.substring("timestamp", 1, 10).alias("date"), F.substring("timestamp", 12, 5).alias("time"), F.coalesce("sender", F.lit("")).alias("sender"), F.concat(F.lit("a\n"), "contact").alias("content"),
        kind.alias("media_type"), F.col("media_file").alias("media_description"), F.when(F.col("edited"), "Read").otherwise("Unknown").alias("message_status"), F.lit(False).alias("is_forwarded"),
        F.col("edited").alias("is_edited"), F.lit(True).alias("is_reply"), F.col("reply_to").alias("reply_preview"), (F.col("seq") % 3 == 0).alias("date_inferred"),
    )


@query
def screenshot_markdown(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "messages").filter("message_id is not null")
    return m.select("message_id", render.screenshot_message(_shot(m)).alias("md"))


@query
def screenshot_document(spark: SparkSession, d: str) -> DataFrame:
    """Whole screenshot documents: the messages of a contact by twenty sequence numbers each."""
    m = _rendered(spark, d).withColumn("page", F.floor((F.col("seq") - 1) / 20))
    shots = m.groupBy("contact", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "message_id", _shot(m).alias("m")))).alias("ms"), F.min("loaded_at").alias("created"), F.max("loaded_at").alias("modified"), F.countDistinct("sender").cast("int").alias("who"))
    shots = shots.withColumns({
        "messages": F.transform("ms", lambda x: x["m"]), "file": F.concat("contact", F.lit(".jpg")), "processed": F.col("modified"), "chat_name": F.col("contact"), "chat_type": F.when(F.col("who") > 2, "group").otherwise("individual"),
        "participant_count": F.when(F.col("who") > 2, F.col("who")), "visible_date_separators": F.array_distinct(F.transform("ms", lambda x: x["m"]["date"])), "screenshot_context": F.when(F.col("page") == 0, "início"),
    })
    return render.screenshot_documents(shots, ["contact", "page"]).select("contact", "page", F.md5("body").alias("body_md5"))


@query
def image_descriptions(spark: SparkSession, d: str) -> DataFrame:
    m = _rendered(spark, d).withColumn("page", F.floor((F.col("seq") - 1) / 20))
    shots = m.groupBy("contact", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "message_id", F.struct("sender", "content").alias("m")))).alias("ms"))
    return shots.select("contact", "page", media.image_description(F.transform("ms", lambda x: x["m"])).alias("description"))


@query
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    """Dates, percentages and payloads as documents and models take them."""
    p = read(spark, d, "parsed")
    return p.select("row_id", chat.iso_time(F.col("loaded_at")).alias("iso"), chat.day_and_time(F.col("loaded_at")).alias("shown"), chat.percent(F.col("row_id") % 1000 / 800).alias("percent"), chat.image_payload(F.encode(F.coalesce("content", F.lit("")), "utf-8")).alias("payload"))


@query
def cleanup_section(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null")
    more = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "\n---\n\n## Outra\n\nfim").otherwise("\n" + render.LEGAL + " nada\nmais")
    text = F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n---\n\n" + render.FULL_TEXT + "\n\n"), F.regexp_replace("text", "---|" + render.LEGAL.replace("*", r"\*"), ""), more))
    return docs.select("doc_id", render.drop_full_text(text).alias("body"))


@query
def stats_union(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed").withColumn("status", F.when(F.col("is_media_omitted"), "failed").when(F.col("type") == "media", "processed").otherwise("skipped"))
    return media.union_stats(media.run_stats(p), media.run_stats(p.filter("batch_no > 0")))


@query
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from chatloom.streaming.ingest import windowed_counts as counts

    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sender"))
    return counts(e).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "sender", "messages")


@query
def trimmed_contents(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "parsed").filter("content is not null")
    return p.select("row_id", F.length(js_trim(F.col("content"))).cast("long").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
