"""Folders of recordings and screenshots into Markdown sidecars: scan, what has none yet, extract, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.operators import media, render
from chatloom.schemas import SCREENSHOT, SPEECH
from chatloom.session import cut
from chatloom.sources import archives as src


def _pending(spark: SparkSession, folder: str, extensions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all files, those without a sidecar): path, modified."""
    found = cut(src.scan_media(spark, folder, extensions))
    return found, cut(found.join(src.pending(found.select("path"), src.scan_sidecars(spark, folder)), "path", "left_semi"))


def _facts(files: DataFrame, processed: str | None) -> DataFrame:
    """file, created, modified, processed of files; file systems keep no other time than the last change."""
    now = F.current_timestamp() if processed is None else F.lit(processed).cast("timestamp")
    return files.withColumns({"file": chat.file_name(F.col("path")), "created": F.col("modified"), "processed": now})


def _write(got: DataFrame, docs: DataFrame, found: DataFrame, todo: DataFrame) -> dict[str, int]:
    written = src.write_documents(docs.select(F.regexp_replace("path", "^file:(?=/)", "").alias("path"), "body"), "", chat.sidecar_path(F.col("path")))
    n = todo.count()
    total = found.count()
    return {"total": total, "pending": n, "processed": written, "errors": got.filter("status = 'failed'").count(), "skipped": total - n}


def _run(todo: DataFrame, call: media.Extractor, schema: str, concurrency: int) -> DataFrame:
    return cut(media.extract(todo.select(F.col("path").alias("key"), "path"), call, schema, concurrency).withColumnRenamed("key", "path"))


def transcribe_audio(spark: SparkSession, folder: str, audio: media.Extractor = media.offline_audio, *, model: str = "offline", concurrency: int = 1, disclaimer: str | None = None, processed: str | None = None) -> dict[str, int]:
    """A speech document beside each recording that has none; a file that fails is counted, the others
    go on. Returns total, pending, processed, errors, skipped."""
    found, todo = _pending(spark, folder, chat.AUDIO_INPUTS)
    got = _run(todo, audio, SPEECH, concurrency)
    good = got.filter("status = 'processed'").select("path", "result.*")
    bodies = render.speech_markdown(render.utterances_of_words(good, ["path"]), ["path"])
    docs = render.audio_documents(_facts(todo, processed).join(good.drop("words", "text"), "path"), bodies, ["path"], model, disclaimer)
    return _write(got, docs, found, todo)


def transcribe_images(spark: SparkSession, folder: str, image: media.Extractor = media.offline_image, *, concurrency: int = 1, disclaimer: str | None = None, processed: str | None = None) -> dict[str, int]:
    """A screenshot document beside each image that has none; counters as in transcribe_audio."""
    found, todo = _pending(spark, folder, chat.IMAGE_INPUTS)
    got = _run(todo, image, SCREENSHOT, concurrency)
    good = got.filter("status = 'processed'").select("path", "result.*")
    docs = render.screenshot_documents(_facts(todo, processed).join(good, "path"), ["path"], disclaimer)
    return _write(got, docs, found, todo)


def transcribe(spark: SparkSession, folder: str, **kw: object) -> dict[str, int]:
    """Recordings, then screenshots; the sums of their counters."""
    parts = [transcribe_audio(spark, folder, **kw), transcribe_images(spark, folder, **kw)]
    return {k: sum(p[k] for p in parts) for k in parts[0]}
