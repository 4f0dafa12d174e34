"""Chat archives and media folders as DataFrames, documents as files."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.session import small
from chatloom.sources import files as fl

# Names a chat log goes by, in order of priority.
LOG_NAMES = ["_chat.txt", "_conversa.txt"]
LOG_PATTERNS = [r"(?i)^WhatsApp Chat.*\.txt$", r"(?i)^Conversa do WhatsApp.*\.txt$"]


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """source_zip, path, zip_order (in path order, which is the merge order), content.

    Only lower-case .zip files of the folder itself. zip_order is the rank of the path in the file
    listing, which the driver holds anyway.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    paths = sorted(r["path"] for r in files.select("path").toLocalIterator())
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths, 1)], "path string, zip_order int")
    return files.join(small(order), "path").select(chat.file_name(F.col("path")).alias("source_zip"), "path", "zip_order", "content")


def pick_log(names: list[str]) -> str | None:
    """The chat log among an archive's entries: exact names, then patterns, then the only .txt."""
    import re

    for want in LOG_NAMES:
        for n in names:
            if n.lower() == want:
                return n
    for pattern in LOG_PATTERNS:
        for n in names:
            if re.match(pattern, n):
                return n
    texts = [n for n in names if n.lower().endswith(".txt")]
    return texts[0] if len(texts) == 1 else None


def decode_text(data: bytes) -> tuple[str, str]:
    """Strict UTF-8, else windows-1252 (called latin-1) with undefined bytes as C1; no byte-order mark."""
    try:
        return data.decode("utf-8").removeprefix("﻿"), "utf-8"
    except UnicodeDecodeError:
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
        return text.removeprefix("﻿"), "latin-1"


def extract_archives(archives: DataFrame) -> DataFrame:
    """source_zip, zip_order, contact_name, chat_log, text, encoding, media_files, error.

    Broken, empty or log-less archives give a row with an error and no text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                log = text = enc = error = None
                media: list[str] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                        names = [os.path.basename(n) for n in z.namelist() if not n.endswith("/")]
                        full = {os.path.basename(n): n for n in z.namelist()}
                        log = pick_log(names)
                        if not names:
                            error = "empty archive"
                        elif log is None:
                            error = "no chat log"
                        else:
                            text, enc = decode_text(z.read(full[log]))
                            media = [n for n in names if n != log]
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    error = f"broken archive: {e}"
                rows.append((r.source_zip, r.zip_order, log, text, enc, media, error))
            yield pd.DataFrame(rows, columns=["source_zip", "zip_order", "chat_log", "text", "encoding", "media_files", "error"])

    got = archives.select("source_zip", "zip_order", "content").mapInPandas(
        run, "source_zip string, zip_order int, chat_log string, text string, encoding string, media_files array<string>, error string"
    )
    return got.withColumn("contact_name", chat.contact_from_zip(F.col("source_zip")))


def media_entries(archives: DataFrame) -> DataFrame:
    """source_zip, zip_order, filename, size, archive_hash of every file beside the log (archives of
    scan_archives). Broken archives have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        log = pick_log([os.path.basename(i.filename) for i in infos])
                        digest = hashlib.sha256(r.content).hexdigest()
                        rows += [(r.source_zip, r.zip_order, os.path.basename(i.filename), i.file_size, digest) for i in infos if os.path.basename(i.filename) != log]
                except (zipfile.BadZipFile, OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["source_zip", "zip_order", "filename", "size", "archive_hash"])

    return archives.select("source_zip", "zip_order", "content").mapInPandas(run, "source_zip string, zip_order int, filename string, size long, archive_hash string")


def media_names(entries: DataFrame) -> DataFrame:
    """entries (source_zip, zip_order, filename, size, archive_hash) with stored_name: a name taken by
    a file of another size gets the first four hash digits of its archive in front."""
    first = entries.groupBy("filename").agg(F.min(F.struct("zip_order", "size")).alias("first"))
    rows = entries.join(first, "filename")
    clash = F.col("size") != F.col("first.size")
    return rows.withColumn("stored_name", F.when(clash, F.concat(F.substring("archive_hash", 1, 4), F.lit("_"), "filename")).otherwise(F.col("filename"))).drop("first")


def stage_media(archives: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """source_zip, filename, stored_name, path of the files written below folder; files already there
    are left. Workers open their own archives; folder must be one that all of them share."""
    per = names.groupBy("source_zip").agg(F.collect_list(F.struct("filename", "stored_name")).alias("files"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    full = {os.path.basename(n): n for n in z.namelist()}
                    for f in r.files:
                        at = fl.join(folder, f["stored_name"])
                        if not fl.exists(at):
                            fl.write_bytes(at, z.read(full[f["filename"]]))
                        rows.append((r.source_zip, f["filename"], f["stored_name"], at))
            yield pd.DataFrame(rows, columns=["source_zip", "filename", "stored_name", "path"])

    return archives.select("source_zip", "content").join(per, "source_zip").mapInPandas(run, "source_zip string, filename string, stored_name string, path string")


def scan_media(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path, modified, length of all files below folder with one of the extensions, in lower or upper
    case (mixed case doesn't count). Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    both = [e for x in extensions for e in (x.lower(), x.upper())]
    files = files.filter(F.element_at(F.split("path", r"\."), -1).isin(both))
    return files.select("path", F.col("modificationTime").alias("modified"), "length").distinct()


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path of all Markdown files below folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder).select("path")


def pending(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """paths (path) without a sidecar among existing (path)."""
    done = existing.select(F.col("path").alias("sidecar")).distinct()
    return paths.withColumn("sidecar", chat.sidecar_path(F.col("path"))).join(done, "sidecar", "left_anti").drop("sidecar")


def write_documents(docs: DataFrame, root: str, path: Column) -> int:
    """Write each row's body to root/path; the number of files. Workers write their own rows; root
    must be a folder all of them share."""
    rows = docs.select(path.alias("path"), "body")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, body in zip(pdf["path"], pdf["body"]):
                fl.write_bytes(fl.join(root, p), body.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    got = rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()
    return got[0]["n"]


def media_placement(messages: DataFrame, staged: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """contact, period, media_file to copy: named by a message, staged (contact, media_file), and not
    placed yet where ``placed`` tells."""
    want = messages.filter("media_file is not null").select("contact", "period", "media_file").distinct()
    want = want.join(staged.select("contact", "media_file").distinct(), ["contact", "media_file"], "left_semi")
    return want if placed is None else want.join(placed, ["contact", "period", "media_file"], "left_anti")


def place_media(wanted: DataFrame) -> int:
    """Copy files (source, target: whole paths) whose target isn't there yet; the number copied."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            n = 0
            for a, b in zip(pdf["source"], pdf["target"]):
                if fl.exists(a) and not fl.exists(b):
                    fl.write_bytes(b, fl.read_bytes(a))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    got = wanted.select("source", "target").distinct().mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()
    return got[0]["n"]
