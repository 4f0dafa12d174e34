"""Media through pluggable extractors with typed results, retry and one status per item.

An audio extractor turns a path into a speech dict (schema SPEECH), an image extractor into a
screenshot dict (schema SCREENSHOT); both run on the workers. Without a model the offline stubs
stand in.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.schemas import SCREENSHOT, SPEECH

Extractor = Callable[[str], dict]


def with_retry(call: Extractor, tries: int = 3, delay_s: float = 0.2, factor: float = 1.0, most_s: float = 10.0) -> Extractor:
    """call, tried again after delay_s, delay_s * factor … up to most_s."""

    def run(item: str) -> dict | None:
        wait = delay_s
        for k in range(tries):
            try:
                return call(item)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(min(wait, most_s))
                wait *= factor
        return None

    return run


def fallback(*calls: Extractor) -> Extractor:
    """The first of calls that succeeds."""

    def run(item: str) -> dict | None:
        error: Exception | None = None
        for call in calls:
            try:
                return call(item)
            except Exception as e:
                error = e
        if error:
            raise error
        return None

    return run


def round_robin(*calls: Extractor) -> Extractor:
    """Each of calls in turn, one item after another."""
    turn = count()
    return lambda item: calls[next(turn) % len(calls)](item)


def offline_audio(item: str) -> dict:
    """Stands in for a speech model where there is none."""
    name = item.rsplit("/", 1)[-1]
    word = {"type": "word", "speaker_id": "speaker_0", "start": 0.0, "end": 1.0, "text": f"[{name}]"}
    return {"text": f"[{name}]", "language_code": "por", "language_probability": 1.0, "words": [word]}


def offline_image(item: str) -> dict:
    """Stands in for a vision model where there is none."""
    name = item.rsplit("/", 1)[-1]
    message = {
        "date": "01/01/1970", "time": "00:00", "sender": "Eu", "content": f"[{name}]", "media_type": "Text", "media_description": None, "message_status": "Unknown",
        "is_forwarded": False, "is_edited": False, "is_reply": False, "reply_preview": None, "date_inferred": False,
    }
    return {"chat_name": name, "chat_type": "individual", "participant_count": None, "visible_date_separators": [], "screenshot_context": None, "messages": [message]}


def image_description(messages: Column) -> Column:
    """The messages of a screenshot as lines "sender: content"."""
    text = lambda m: F.concat(F.coalesce(m["sender"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(messages, text), "\n")


def extract(items: DataFrame, call: Extractor, schema: str, concurrency: int = 3) -> DataFrame:
    """key, status, error, result (struct of schema) of items (key, path): one call an item, whose
    failure is the item's own. concurrency: tasks at once."""
    if concurrency < 1:
        raise ValueError("concurrency must be at least 1")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, path in zip(pdf["key"], pdf["path"]):
                try:
                    rows.append((key, "processed", None, call(path)))
                except Exception as e:
                    rows.append((key, "failed", str(e), None))
            yield pd.DataFrame(rows, columns=["key", "status", "error", "result"])

    return items.select("key", "path").repartition(concurrency).mapInPandas(run, f"key string, status string, error string, result struct<{schema}>")


def process_media(items: DataFrame, mode: str = "all", concurrency: int = 3, audio: Extractor = offline_audio, image: Extractor = offline_image) -> DataFrame:
    """key, status, transcription, error of items (key, path, status) that are pending or failed.

    mode: audio, images or all. A recording's transcription is its text, an image's the lines of its
    messages. Files of other kinds are skipped. concurrency: tasks at once.
    """
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.when(ext.isin(chat.AUDIO_INPUTS), "audio").when(ext.isin(chat.IMAGE_INPUTS), "images")
    todo = items.filter(F.col("status").isin("pending", "failed")).withColumn("kind", kind)
    spoken = extract(todo.filter("kind = 'audio'"), audio, SPEECH, concurrency).select("key", "status", F.coalesce("result.text", F.when(F.col("status") == "processed", "")).alias("transcription"), "error")
    seen = extract(todo.filter("kind = 'images'"), image, SCREENSHOT, concurrency).select("key", "status", image_description(F.col("result.messages")).alias("transcription"), "error")
    none = F.lit(None).cast("string")
    other = todo.filter("kind is null").select("key", F.lit("skipped").alias("status"), none.alias("transcription"), none.alias("error"))
    return {"audio": spoken, "images": seen, "all": spoken.unionByName(seen).unionByName(other)}[mode]


def run_stats(results: DataFrame) -> DataFrame:
    """One row of counters."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "skipped", "pending")], F.count("*").alias("total"))


def union_stats(*parts: DataFrame) -> DataFrame:
    """The sum of counter rows; a missing part counts as zero."""
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p, allowMissingColumns=True)
    return got.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in got.columns])
