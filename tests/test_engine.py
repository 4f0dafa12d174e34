import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chatloom.operators import media, ordering, render, store
from chatloom.plans.ingest import IngestOptions, ingest, parse_options
from chatloom.plans.transcribe import transcribe_audio, transcribe_images
from chatloom.sources import archives as src


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)


def test_archives(spark, tmp_path):
    make_zip(tmp_path / "WhatsApp Chat with Ana.zip", {"_chat.txt": "﻿olá", "a.jpg": b"1"})
    make_zip(tmp_path / "b.zip", {"x.txt": "caf\xe9".encode("cp1252")})
    make_zip(tmp_path / "c.zip", {"a.jpg": b"1"})
    (tmp_path / "d.zip").write_bytes(b"broken")
    make_zip(tmp_path / "e.zip", {})
    got = {r["source_zip"]: r for r in src.extract_archives(src.scan_archives(spark, str(tmp_path))).collect()}
    assert got["WhatsApp Chat with Ana.zip"]["text"] == "olá" and got["WhatsApp Chat with Ana.zip"]["media_files"] == ["a.jpg"]
    assert (got["b.zip"]["text"], got["b.zip"]["encoding"]) == ("café", "latin-1")
    assert got["c.zip"]["error"] == "no chat log" and got["d.zip"]["error"] and got["e.zip"]["error"] == "empty archive"
    assert [got[k]["zip_order"] for k in sorted(got)] == [1, 2, 3, 4, 5]


def test_decode_undefined_bytes():
    assert src.decode_text(b"\x81\xe9") == ("\x81é", "latin-1")


def test_ingest_twice(spark, tmp_path):
    src_dir, out = tmp_path / "in", tmp_path / "out"
    src_dir.mkdir()
    make_zip(src_dir / "WhatsApp Chat with Ana.zip", {"_chat.txt": "1/16/26, 10:09 - Ana: hello\n1/16/26, 10:10 - Me: hi\nthere\n1/17/26, 09:00 - Ana: bye\n"})
    make_zip(src_dir / "WhatsApp Chat with Bo.zip", {"_chat.txt": "1/16/26, 11:09 - Bo: hello\n1/16/26, 11:10 - Me: hi\n"})
    opts = IngestOptions(input=str(src_dir), output=str(out))
    first = ingest(spark, opts)
    assert (first["archives"], first["added"], first["documents"]) == (2, 5, 2)
    doc = (out / "2026.01.12-2026.01.18" / "Ana.md").read_text()
    assert "## 16/01 sex" in doc and "`10:10` **Eu:** hi\nthere" in doc and doc.count("## ") == 2 and "messages: 3" in doc
    again = ingest(spark, opts)
    assert (again["added"], again["skipped"]) == (0, 5)
    with pytest.raises(ValueError, match="force"):
        ingest(spark, IngestOptions(input=str(src_dir), output=str(out), split="1mo"))
    forced = ingest(spark, IngestOptions(input=str(src_dir), output=str(out), split="1mo", force=True, regenerate=True))
    assert forced["documents"] == 2 and os.path.exists(out / "2026.01.01-2026.01.31" / "Ana.md")


def test_ingest_media(spark, tmp_path):
    src_dir, out = tmp_path / "in", tmp_path / "out"
    src_dir.mkdir()
    log = "1/16/26, 10:09 - Ana: a.opus (file attached)\n1/16/26, 10:10 - Ana: b.jpg (file attached)\n1/16/26, 10:11 - Ana: gone.jpg (file attached)\n1/16/26, 10:12 - Me: ok\n"
    make_zip(src_dir / "WhatsApp Chat with Ana.zip", {"_chat.txt": log, "a.opus": b"123", "b.jpg": b"45", "d.pdf": b"6"})
    make_zip(src_dir / "WhatsApp Chat with Bo.zip", {"_chat.txt": "first\n1/16/26, 11:09 - Bo: a.opus (file attached)\n1/16/26, 11:10 - Me: hi\n", "a.opus": b"other"})

    def picky(item):
        if item.endswith("b.jpg"):
            raise ValueError("blurred")
        return media.offline_image(item)

    opts = IngestOptions(input=str(src_dir), output=str(out), media="all", aliases={"Bo": "Bob"})
    dry = ingest(spark, IngestOptions(input=str(src_dir), output=str(out), dry_run=True))
    assert dry["pending_media"] == 4 and dry["periods"] == 2 and not out.exists()
    got = ingest(spark, opts, image=picky)
    assert (got["media_processed"], got["media_failed"], got["media_skipped"], got["placed"], got["warnings"]) == (2, 1, 1, 3, 1)
    ana = (out / "2026.01.12-2026.01.18" / "Ana.md").read_text()
    assert "![[medias/a.opus]]\n> **[Transcrição]** [a.opus]" in ana and "![[medias/gone.jpg]] <!-- media:missing -->" in ana and "![[medias/b.jpg]]\n" in ana
    assert (out / "2026.01.12-2026.01.18" / "medias" / "b.jpg").read_bytes() == b"45"
    staged = sorted(p.name for p in (out / "_medias_staging").iterdir())
    assert len(staged) == 4 and "a.opus" in staged and sum(p.endswith("_a.opus") for p in staged) == 1
    # the failed one is tried again; aliases and self are those of the first run
    again = ingest(spark, IngestOptions(input=str(src_dir), output=str(out), media="images"))
    assert again["media_processed"] == 1 and again["skipped"] == 6
    assert "> **[Descrição]** Eu: [b.jpg]" in (out / "2026.01.12-2026.01.18" / "Ana.md").read_text()
    assert "**Bob:**" in (out / "2026.01.12-2026.01.18" / "Bo.md").read_text()
    state = store.load_snapshot(spark, str(out / ".index"))
    assert state["warnings"].count() == 1 and state["runs"].count() == 2 and state["media"].filter("status = 'processed'").count() == 3


def test_transcribe_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.opus", "d/b.MP3", "d/c.jpg", "d/e.png", "f.Jpg"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "g.jpeg").write_bytes(b"x")
    (tmp_path / "g.md").write_text("done")

    def fail(item):
        if item.endswith("b.MP3"):
            raise ValueError("no")
        return media.offline_audio(item) | {"language_probability": 0.9525}

    got = transcribe_audio(spark, str(tmp_path), fail, model="m", disclaimer="legal", processed="2026-01-16 10:09:00")
    assert got == {"total": 2, "pending": 2, "processed": 1, "errors": 1, "skipped": 0}
    doc = (tmp_path / "a.md").read_text()
    assert 'data_transcricao: "2026-01-16T10:09:00.000Z"\nidioma_detectado: "por"\nprobabilidade_idioma: 95.3%\nmodelo: "m"' in doc
    assert "16/01/2026 às 10:09:00" in doc and doc.endswith("> [a.opus]\n\n---\n\nlegal\n") and "## Transcrição Completa\n\n**[00:00.00 - 00:01.00] speaker_0:**" in doc
    assert transcribe_images(spark, str(tmp_path)) == {"total": 2, "pending": 1, "processed": 1, "errors": 0, "skipped": 1}
    shot = (tmp_path / "d" / "c.md").read_text()
    assert shot.startswith('---\narquivo_origem: "c.jpg"\n') and "# Transcrição de Captura WhatsApp" in shot and "> [c.jpg]" in shot
    assert transcribe_audio(spark, str(tmp_path))["pending"] == 1


def test_days_that_alternate(spark):
    rows = [("C", "p", k, str(k), f"2026-01-{d}T10:00:00", "a", f"m{k}", "text") for k, d in enumerate(("16", "16", "17", "16"), 1)]
    m = spark.createDataFrame(rows, "contact string, period string, seq long, message_id string, timestamp string, sender string, content string, type string")
    m = m.withColumns({c: F.lit(None).cast(t) for c, t in (("subtype", "string"), ("media_file", "string"), ("is_media_omitted", "boolean"), ("edited", "boolean"), ("transcription", "string"), ("media_exists", "boolean"))})
    m = m.withColumn("edited", F.lit(False))
    days = render.day_bodies(m, F.col("sender")).orderBy("run").collect()
    assert [(d["header"], d["messages"]) for d in days] == [("## 16/01 sex", 2), ("## 17/01 sáb", 1), ("## 16/01 sex", 1)]


def test_options():
    o = parse_options(["--split", "1mo", "--alias", "a=b=c", "--dry-run", "--unknown", "x"])
    assert o.split == "1mo" and o.aliases == {"a": "b=c"} and o.dry_run
    for bad in (["--split", "9w"], ["--alias", "x"], ["--concurrency", "0"]):
        with pytest.raises(ValueError, match=".+"):
            parse_options(bad)


def test_media(spark):
    items = spark.createDataFrame([("1", "a/x.opus", "pending"), ("2", "a/y.jpg", "failed"), ("3", "a/z.pdf", "pending"), ("4", "a/q.opus", "processed")], "key string, path string, status string")

    def fail(_):
        raise ValueError("no")

    got = {r["key"]: (r["status"], r["transcription"]) for r in media.process_media(items, image=media.fallback(fail, media.offline_image)).collect()}
    assert got == {"1": ("processed", "[x.opus]"), "2": ("processed", "Eu: [y.jpg]"), "3": ("skipped", None)}
    turn = media.round_robin(lambda i: {"a": i}, lambda i: {"b": i})
    assert [turn("x"), turn("y"), turn("z")] == [{"a": "x"}, {"b": "y"}, {"a": "z"}]
    bad = {r["key"]: r["status"] for r in media.process_media(items, "audio", audio=media.with_retry(fail, 2, 0)).collect()}
    assert bad == {"1": "failed"}
    stats = media.union_stats(media.run_stats(items), media.run_stats(items)).first()
    assert stats["total"] == 8 and stats["pending"] == 4


def test_word_utterances(spark):
    words = [("word", "a", 0.0, 1.0, "oi"), ("spacing", "a", 1.0, 1.1, " "), ("word", "a", 1.1, 2.0, "bem"), ("word", None, 2.0, None, "sim")]
    df = spark.createDataFrame([(1, words), (2, [])], "k int, words array<struct<type:string,speaker_id:string,start:double,end:double,text:string>>")
    u = render.utterances_of_words(df, ["k"])
    assert [tuple(r)[2:] for r in u.orderBy("utterance_no").collect()] == [("a", 0.0, 2.0, "oi bem"), ("Desconhecido", 2.0, None, "sim")]
    assert render.speech_markdown(u, ["k"]).first()["body"] == "**[00:00.00 - 00:02.00] a:**\n> oi bem\n\n**[00:02.00 - --:--] Desconhecido:**\n> sim\n"


def test_cleanup(spark):
    part = "a\n---\n\n" + render.FULL_TEXT + "\n\nb"
    rows = [(1, part), (2, part + "\n---\n\n## C\n"), (3, "a"), (4, part + "\n> **Aviso Legal:** z"), (5, part + "😂😂\n---\n\n## C\n")]
    got = {r["k"]: r["b"] for r in spark.createDataFrame(rows, "k int, t string").select("k", render.drop_full_text(F.col("t")).alias("b")).collect()}
    assert got == {1: "a\n", 2: "a\n\n---\n\n## C\n", 3: "a", 4: "a\n---\n\n> **Aviso Legal:** z\n", 5: "a\n\n---\n\n## C\n"}


def test_sliced_order_matches_whole(spark):
    rows = [(k, i, "ab"[(i // 3 + i % 5) % 2]) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    got = {(r["k"], r["i"]): r for r in ordering.islands(ordering.number_rows(df, ["k"], F.floor(F.col("i") / 7), ["i"], "n"), ["k"], F.floor(F.col("i") / 7), ["i"], F.col("v"), "isle").collect()}
    new = {(r["k"], r["i"]): r["c"] for r in ordering.changes(df, ["k"], F.floor(F.col("i") / 7), ["i"], F.col("v"), "c").collect()}
    for k in (1, 2):
        isle, last = 0, None
        for i in range(40):
            v = rows[i][2]
            assert new[k, i] == (v != last)
            isle += v != last
            last = v
            assert got[k, i]["n"] == i + 1 and got[k, i]["isle"] == isle


def test_contract():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "p7_found" in q and len(o) >= 50


def test_core_does_not_need_llm():
    root = os.path.dirname(__spark_entry__.__file__)
    for folder, _, files in os.walk(os.path.join(root, "chatloom")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "chatloom.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_zip_names_in_memory():
    assert src.pick_log(["a.txt", "_CHAT.TXT"]) == "_CHAT.TXT" and src.pick_log(["a.txt", "b.txt"]) is None and io.BytesIO().read() == b""
