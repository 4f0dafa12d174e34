"""Chat logs into messages: lines, blocks, typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.operators.ordering import last_before, number_rows

SLICE = 8192


def log_lines(logs: DataFrame, *, drop_last_empty: bool = True, normalize_newlines: bool = False) -> DataFrame:
    """source_zip, line_no (from 1), line of logs (source_zip, text).

    drop_last_empty: a newline at the end of a log makes no empty line, so a message reads the same
    in a longer export. normalize_newlines: CRLF counts as LF. Null texts have no lines.
    """
    text = F.col("text")
    if normalize_newlines:
        text = F.regexp_replace(text, "\r\n?", "\n")
    if drop_last_empty:
        text = F.regexp_replace(text, r"\n\z", "")
    return logs.filter("source_zip is not null and text is not null").select("source_zip", F.posexplode(F.split(text, "\n")).alias("i", "line")).select(
        "source_zip", (F.col("i") + 1).alias("line_no"), "line"
    )


def detect_formats(lines: DataFrame) -> DataFrame:
    """source_zip, language, date_format: the first of five lines that shows a language; the first
    twenty dated lines vote on the order of day and month."""
    low = F.lower("line")
    lang = F.when(low.contains("criptografia de ponta a ponta"), "pt-br").when(low.contains("end-to-end encrypted"), "en").when(low.contains("conversa do whatsapp"), "pt-br")
    field = lambda i: F.regexp_extract("line", r"^\[?(\d{1,2})/(\d{1,2})/\d{2,4}", i)
    dated = lines.filter(field(1) != "").select("source_zip", "line_no", field(1).cast("int").alias("a"), field(2).cast("int").alias("b"))
    votes = _first_dated(dated).groupBy("source_zip").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    langs = lines.groupBy("source_zip").agg(F.coalesce(F.min_by(lang, F.when((F.col("line_no") <= 5) & lang.isNotNull(), F.col("line_no"))), F.lit("en")).alias("language"))
    fmt = F.when(F.col("a") > 12, "DD/MM").when(F.col("b") > 12, "MM/DD").when(F.col("language") == "pt-br", "DD/MM").otherwise("MM/DD")
    return langs.join(votes, "source_zip", "left").select("source_zip", "language", fmt.alias("date_format"))


def _first_dated(dated: DataFrame) -> DataFrame:
    numbered = number_rows(dated, ["source_zip"], F.floor(F.col("line_no") / SLICE), ["line_no"], "__r")
    return numbered.filter("__r <= 20").drop("__r")


def blocks(lines: DataFrame) -> DataFrame:
    """source_zip, line_start, line_end, date, time, half, body: one row per message; lines before
    the first message have a null line_start (see warnings)."""
    rows = lines.withColumn("m", chat.start_parts(F.col("line")))
    rows = rows.withColumns({f"m_{k}": v for k, v in chat.start_fields(F.col("m")).items()}).drop("m")
    rows = last_before(rows, ["source_zip"], F.floor(F.col("line_no") / SLICE), ["line_no"], F.when(F.col("m_is_start"), F.col("line_no")), "line_start")
    piece = F.when(F.col("m_is_start"), F.col("m_body")).otherwise(F.col("line"))
    return rows.filter("line_start is not null").groupBy("source_zip", "line_start").agg(
        F.max("line_no").alias("line_end"),
        *[F.max(F.when(F.col("m_is_start"), F.col(f"m_{k}"))).alias(k) for k in ("date", "time", "half")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("x")))), lambda s: s["x"]), "\n").alias("body"),
    )


def warnings(lines: DataFrame) -> DataFrame:
    """source_zip, line_no, warning for each line before a log's first message."""
    rows = lines.withColumn("s", chat.start_parts(F.col("line")).isNotNull())
    first = rows.filter("s").groupBy("source_zip").agg(F.min("line_no").alias("first"))
    early = rows.join(first, "source_zip", "left").filter("first is null or line_no < first")
    return early.select("source_zip", "line_no", F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": unparseable: "), F.col("line")).alias("warning"))


def parse_lines(lines: DataFrame, date_format: str | None = None) -> DataFrame:
    """Typed messages (schema PARSED) of log lines; date_format overrides the vote.

    Nulls in line count as empty continuation lines of no start; empty tables give empty results.
    """
    b = blocks(lines.withColumn("line", F.coalesce("line", F.lit(""))))
    if date_format:
        b = b.withColumn("fmt", F.lit(date_format))
    else:
        b = b.join(detect_formats(lines).select("source_zip", F.col("date_format").alias("fmt")), "source_zip")
    s = chat.split_body(F.col("body"))
    b = b.withColumns(s).withColumn("timestamp", chat.resolve_timestamp(F.col("date"), F.col("time"), F.col("half"), F.col("fmt")))
    b = chat.content_rules(b, F.col("raw"), "c")
    again = F.col("c.media_file").isNotNull() & F.col("body").contains("\n")
    clean = chat.without_echo(F.col("body"), F.col("c.media_file"))
    after = F.regexp_replace(clean, r"^[^:]+:[\s ﻿ ]*", "")
    b = chat.content_rules(b, F.when(again, after), "c2").withColumn("c2", F.when(again, F.col("c2")))
    both = lambda f: F.coalesce(F.col(f"c2.{f}"), F.col(f"c.{f}"))
    typ = F.when(F.col("system"), "system").otherwise(F.when(F.col("c.media_file").isNotNull() & (both("type") == "text"), "media").otherwise(both("type")))
    media = F.when(~F.col("system"), both("media_file"))
    out = b.select(
        "source_zip", "line_start", "line_end", "timestamp", "sender",
        F.when(F.col("system"), F.col("body")).otherwise(both("content")).alias("content"),
        typ.alias("type"),
        F.when(F.col("system"), chat.system_subtype(F.col("body"))).otherwise(chat.media_subtype(media)).alias("subtype"),
        media.alias("media_file"),
        (~F.col("system") & both("omitted")).alias("is_media_omitted"),
        (~F.col("system") & (F.col("c.edited") | F.coalesce(F.col("c2.edited"), F.lit(False)))).alias("edited"),
        F.lit(None).cast("string").alias("reply_to"),
    )
    out = number_rows(out, ["source_zip"], F.floor(F.col("line_start") / SLICE), ["line_start"], "pos")
    return out.withColumn("pos", F.col("pos").cast("int"))
