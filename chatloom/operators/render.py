"""Documents: period Markdown, speech and screenshot Markdown, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.functions.periods import day_header, lenient_date
from chatloom.functions.text import js_trim
from chatloom.operators.ordering import islands

SLICE = 8192

# Labels of the documents.
MEDIA_LABELS = {
    "Text": "Texto", "Image": "Imagem", "Video": "Vídeo", "VoiceMessage": "Áudio", "Document": "Documento", "Sticker": "Figurinha",
    "Gif": "GIF", "Contact": "Contato", "Location": "Localização", "LinkPreview": "Link", "Deleted": "Apagada", "Poll": "Enquete",
}
STATUS_LABELS = {"Pending": "⏱️", "Sent": "✓", "Delivered": "✓✓", "Read": "✓✓ (lida)", "Unknown": ""}
LEGEND = [
    "---", "", "## Legenda", "", "- ⚠️ Data inferida (não explícita na captura)", "- ↩️ Mensagem encaminhada", "- ✏️ Mensagem editada",
    "- 📎 Anexo de mídia", "- ✓ Enviada | ✓✓ Entregue | ✓✓ (lida) Visualizada", "", "---", "", "*Transcrito automaticamente de captura de tela do WhatsApp*", "",
]
FULL_TEXT = "## Texto Integral (sem formatação)"
LEGAL = "> **Aviso Legal:**"
INFERRED_NOTE = ' mensagem(ns) com data inferida a partir de "HOJE"/"ONTEM" e data do arquivo.'


def _map(table: dict[str, str], c: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), default)


def media_label(c: Column) -> Column:
    return _map(MEDIA_LABELS, c, c)


def status_label(c: Column) -> Column:
    return _map(STATUS_LABELS, c, F.lit(""))


def message_markdown(who: Column) -> Column:
    """One message (columns timestamp, content, type, subtype, media_file, is_media_omitted, edited,
    transcription, media_exists) as Markdown; ``who`` is the name shown."""
    time = F.concat(F.lit("`"), F.substring("timestamp", 12, 5), F.lit("` "))
    content = F.coalesce("content", F.lit(""))
    bold = F.concat(time, F.lit("**"), who, F.lit(":**"))
    has = content != ""
    label = F.when(F.col("subtype") == "image", "Descrição").otherwise("Transcrição")
    media = F.concat_ws(
        "\n",
        bold,
        F.concat(F.lit("![[medias/"), F.col("media_file"), F.lit("]]"), F.when(F.coalesce("media_exists", F.lit(True)), "").otherwise(" <!-- media:missing -->")),
        F.when(F.coalesce(F.col("transcription"), F.lit("")) != "", F.concat(F.lit("> **["), label, F.lit("]** "), F.col("transcription"))),
        F.when(has, content),
    )
    return (
        F.when(F.col("type") == "system", F.concat(time, F.lit("_"), content, F.lit("_")))
        .when(F.col("type") == "deleted", F.concat(bold, F.lit(" _"), content, F.lit("_")))
        .when(F.coalesce("is_media_omitted", F.lit(False)), F.concat(bold, F.lit(" <Mídia oculta>"), F.when(has, F.concat(F.lit("\n"), content)).otherwise("")))
        .when((F.col("type") == "media") & F.col("media_file").isNotNull(), media)
        .otherwise(F.concat(bold, F.lit(" "), content, F.when(F.col("edited"), " _(editada)_").otherwise("")))
    )


def day_bodies(messages: DataFrame, who: Column) -> DataFrame:
    """contact, period, run, header, body, messages: runs of messages of one day (day and month), in
    seq order; a day that comes back after another is a run of its own.

    Runs, not whole documents, are gathered first, so a task holds one day of one chat.
    """
    rows = messages.select("contact", "period", "seq", "message_id", lenient_date(F.col("timestamp")).alias("day"), F.substring("timestamp", 6, 5).alias("label"), message_markdown(who).alias("md"))
    rows = islands(rows, ["contact", "period"], F.floor(F.col("seq") / SLICE), ["seq", "message_id"], F.col("label"), "run")
    order = F.struct("seq", "message_id")
    return rows.groupBy("contact", "period", "run").agg(
        F.min_by("day", order).alias("day"),
        F.count("*").alias("messages"),
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message_id", "md"))), lambda x: x["md"]), "\n\n"), F.lit("\n")).alias("body"),
    ).withColumn("header", F.concat(F.lit("## "), day_header(F.col("day"))))


def period_documents(messages: DataFrame, contacts: DataFrame, who: Column, disclaimer: str | None = None) -> DataFrame:
    """contact, period, path parts and body of each period document.

    A chat's messages follow seq, with a header at each change of day. contacts: contact, type, source_zips, sanitized_name.
    """
    days = day_bodies(messages, who)
    docs = days.groupBy("contact", "period").agg(
        F.sum("messages").alias("messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", F.concat("header", F.lit("\n\n"), "body").alias("x")))), lambda s: s["x"]), "\n").alias("text"),
    )
    docs = docs.join(contacts.select("contact", "type", "source_zips", "sanitized_name"), "contact")
    show = lambda i: F.concat_ws("/", *[F.get(F.split(F.get(F.split("period", "-"), F.lit(i)), r"\."), F.lit(k)) for k in (2, 1, 0)])
    head = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("contact: "), "sanitized_name"), F.concat(F.lit("type: "), "type"), F.concat(F.lit("period: "), "period"), F.concat(F.lit("messages: "), F.col("messages").cast("string")),
        F.lit("sources:"), F.array_join(F.transform("source_zips", lambda z: F.concat(F.lit("  - "), z)), "\n"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), "sanitized_name", F.lit(" — "), show(0), F.lit(" a "), show(1)), F.lit(""),
    )
    tail = f"\n---\n\n{disclaimer}\n" if disclaimer else ""
    return docs.select("contact", "period", "sanitized_name", "messages", F.concat(head, F.lit("\n"), "text", F.lit(tail)).alias("body"))


def output_path(layout: str) -> Column:
    """The document's path below the output folder."""
    a, b = (F.col("period"), F.col("sanitized_name")) if layout == "by-period" else (F.col("sanitized_name"), F.col("period"))
    return F.concat(a, F.lit("/"), b, F.lit(".md"))


def utterances_of_words(speech: DataFrame, keys: list[str]) -> DataFrame:
    """keys, utterance_no, speaker, start_time, end_time, text from a column ``words`` (schema WORDS).

    Islands of one speaker; spacing words don't count; a missing speaker is Desconhecido. Built
    from the word array itself, so nothing is shuffled.
    """
    words = F.filter("words", lambda w: w["type"] != "spacing")
    name = lambda w: F.coalesce(w["speaker_id"], F.lit("Desconhecido"))
    new = lambda w: F.struct(name(w).alias("speaker"), w["start"].alias("start_time"), w["end"].alias("end_time"), w["text"].alias("text"))
    kind = "array<struct<speaker:string,start_time:double,end_time:double,text:string>>"
    step = lambda acc, w: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["speaker"] == name(w)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["speaker"].alias("speaker"), F.try_element_at(acc, F.lit(-1))["start_time"].alias("start_time"), w["end"].alias("end_time"), F.concat(F.try_element_at(acc, F.lit(-1))["text"], F.lit(" "), w["text"]).alias("text"))))).otherwise(F.concat(acc, F.array(new(w))))
    folded = F.aggregate(words, F.array().cast(kind), step)
    return speech.select(*keys, F.posexplode(folded).alias("i", "u")).select(*keys, (F.col("i") + 1).alias("utterance_no"), "u.*")


def speech_markdown(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: the utterance part of a speech document."""
    line = F.concat(F.lit("**["), chat.clock(F.col("start_time")), F.lit(" - "), chat.clock(F.col("end_time")), F.lit("] "), "speaker", F.lit(":**\n> "), js_trim(F.coalesce("text", F.lit(""))), F.lit("\n"))
    return utterances.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utterance_no", line.alias("x")))), lambda s: s["x"]), "\n").alias("body"))


def _file_items(done: str) -> tuple[list[Column], list[Column]]:
    """Front matter and list of a file's facts (columns file, created, modified, processed)."""
    quoted = lambda k, c: F.concat(F.lit(f'{k}: "'), c, F.lit('"'))
    front = [quoted("arquivo_origem", F.col("file")), quoted("data_criacao_arquivo", chat.iso_time(F.col("created"))), quoted("data_modificacao_arquivo", chat.iso_time(F.col("modified"))), quoted(done, chat.iso_time(F.col("processed")))]
    item = lambda label, c: F.concat(F.lit(f"- **{label}:** "), c)
    facts = [item("Arquivo de origem", F.concat(F.lit("`"), "file", F.lit("`"))), item("Data de criação do arquivo", chat.day_and_time(F.col("created"))), item("Data de modificação do arquivo", chat.day_and_time(F.col("modified")))]
    return front, facts


def audio_documents(files: DataFrame, bodies: DataFrame, keys: list[str], model: str, disclaimer: str | None = None) -> DataFrame:
    """keys, body: whole speech documents. files: keys, file, created, modified, processed,
    language_code, language_probability; bodies: the result of speech_markdown (a file without
    utterances has none)."""
    front, facts = _file_items("data_transcricao")
    sure = chat.percent(F.col("language_probability"))
    head = F.concat_ws(
        "\n", F.lit("---"), *front, F.concat(F.lit('idioma_detectado: "'), "language_code", F.lit('"')), F.concat(F.lit("probabilidade_idioma: "), sure), F.lit(f'modelo: "{model}"'),
        F.lit("---"), F.lit(""), F.lit("# Transcrição de Áudio"), F.lit(""), F.lit("## Metadados"), F.lit(""), *facts,
        F.concat(F.lit("- **Data da transcrição:** "), chat.day_and_time(F.col("processed"))), F.concat(F.lit("- **Idioma detectado:** "), "language_code", F.lit(" ("), sure, F.lit(" de confiança)")),
        F.lit(""), F.lit("---"), F.lit(""), F.lit("## Transcrição Completa"), F.lit(""), F.lit(""),
    )
    tail = f"\n---\n\n{disclaimer}\n" if disclaimer else ""
    return files.join(bodies.select(*keys, F.col("body").alias("said")), keys, "left").select(*keys, F.concat(head, F.coalesce("said", F.lit("")), F.lit(tail)).alias("body"))


def screenshot_message(m: Column) -> Column:
    """One message struct of a screenshot as Markdown."""
    no = F.lit("")
    flag = lambda c, s: F.when(F.coalesce(c, F.lit(False)), s).otherwise("")
    head = F.concat(F.lit("### "), m["date"], flag(m["date_inferred"], " ⚠️"), F.lit(" "), m["time"], F.lit(" - "), m["sender"], flag(m["is_forwarded"], " ↩️ Encaminhada"), flag(m["is_edited"], " ✏️"))
    reply = F.when(F.coalesce(m["is_reply"], F.lit(False)) & (F.coalesce(m["reply_preview"], no) != ""), F.concat(F.lit('> _Em resposta a:_ "'), m["reply_preview"], F.lit('"\n')))
    media = F.when(m["media_type"] != "Text", F.concat(F.lit("> 📎 **["), media_label(m["media_type"]), F.lit("]**"), F.when(F.coalesce(m["media_description"], no) != "", F.concat(F.lit(" "), m["media_description"])).otherwise("")))
    text = F.when(F.coalesce(m["content"], no) != "", F.array_join(F.transform(F.split(m["content"], "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
    status = status_label(m["message_status"])
    return F.concat_ws("\n", head, reply, media, text, F.when(status != "", F.concat(F.lit("> _"), status, F.lit("_"))), no)


def screenshot_documents(shots: DataFrame, keys: list[str], disclaimer: str | None = None) -> DataFrame:
    """keys, body of screenshots (schema SCREENSHOT): metadata, messages, legend. Where shots has the
    file's facts (file, created, modified, processed), the front matter and those facts too."""
    inferred = F.size(F.filter("messages", lambda m: F.coalesce(m["date_inferred"], F.lit(False))))
    item = lambda label, c: F.concat(F.lit(f"- **{label}:** "), c)
    seps = F.coalesce("visible_date_separators", F.array().cast("array<string>"))
    front, facts = [], []
    if "file" in shots.columns:
        front, facts = _file_items("data_extracao")
        value = lambda k, c: F.concat(F.lit(f"{k}: "), c)
        text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        front = [
            F.lit("---"), *front, value("chat", text(F.col("chat_name"))), value("tipo_chat", text(F.col("chat_type"))), value("total_mensagens", F.size("messages").cast("string")),
            value("datas_inferidas", inferred.cast("string")), F.lit("---"), F.lit(""), F.lit("# Transcrição de Captura WhatsApp"), F.lit(""),
        ]
        facts.append(F.concat(F.lit("- **Data da extração:** "), chat.day_and_time(F.col("processed"))))
    head = F.concat_ws(
        "\n", *front, F.lit("## Metadados"), F.lit(""), *facts, item("Chat", F.col("chat_name")), item("Tipo", F.when(F.col("chat_type") == "group", "Grupo").otherwise("Conversa individual")), item("Total de mensagens", F.size("messages").cast("string")),
        F.when(F.coalesce("participant_count", F.lit(0)) != 0, item("Participantes", F.col("participant_count").cast("string"))),
        F.when(F.size(seps) > 0, item("Separadores de data visíveis", F.array_join(seps, ", "))),
        F.when(inferred > 0, F.concat(F.lit("\n> ⚠️ **Nota:** "), inferred.cast("string"), F.lit(INFERRED_NOTE))),
        F.lit(""),
        F.when(F.coalesce("screenshot_context", F.lit("")) != "", F.concat(F.lit("## Contexto do Sistema\n\n> "), "screenshot_context", F.lit("\n"))),
        F.lit("---"), F.lit(""), F.lit("## Mensagens"), F.lit(""),
    )
    text = F.array_join(F.transform("messages", screenshot_message), "\n")
    tail = "\n".join(LEGEND) + (f"\n{disclaimer}\n" if disclaimer else "")
    return shots.select(*keys, F.concat_ws("\n", head, F.when(F.size("messages") > 0, text), F.lit(tail)).alias("body"))


def drop_full_text(body: Column) -> Column:
    """A document without its unformatted copy of the text; a following section or a legal notice
    stays; documents without such a section are unchanged."""
    mark = "---\n\n" + FULL_TEXT
    at = F.instr(body, mark)
    before = F.substring(body, F.lit(1), at - 1)
    after = F.substring(body, at + 4, F.length(body))
    # not by position: a pattern's positions count UTF-16 units, those of a substring code points
    rest = F.regexp_extract(after, r"(?s)\n---\n\n(?!## Texto Integral).*\z", 0)
    legal = F.regexp_extract(body, rf"(?s){LEGAL.replace('*', chr(92) + '*')}.+\z", 0)
    out = F.when(rest != "", F.concat(before, rest)).when(legal != "", F.concat(before, F.lit("---\n\n"), legal, F.lit("\n"))).otherwise(before)
    return F.when(at > 0, F.when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))).otherwise(body)
