import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.functions.periods import lenient_date, period_boundaries, period_label
from chatloom.functions.text import js_trim, remove_first, sender_key
from chatloom.operators import dedup, parser, store
from chatloom.plans import queries


def parse(spark, text, **kw):
    rows = parser.parse_lines(parser.log_lines(spark.createDataFrame([("z", text)], "source_zip string, text string")), **kw)
    return rows.orderBy("pos").collect()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_english_chat(spark):
    r = parse(spark, "1/4/26, 00:09 - Messages are end-to-end encrypted.\n1/16/26, 10:09 - Ana: hello\n1/16/26, 10:10 - Ana: <Media omitted>\n")
    assert [x["type"] for x in r] == ["system", "text", "media"]
    assert r[0]["subtype"] == "encryption" and r[1]["timestamp"] == "2026-01-16T10:09:00" and r[2]["is_media_omitted"]


def test_bracketed_and_attached(spark):
    r = parse(spark, "[25/03/2026, 14:30:45] Ana: oi\n[25/03/2026, 14:30:45] Ana: a b.opus (arquivo anexado)\na b.opus\nfim")
    assert r[0]["timestamp"] == "2026-03-25T14:30:45"
    assert (r[1]["media_file"], r[1]["subtype"], r[1]["content"]) == ("a b.opus", "audio", "fim")


def test_lines_and_trailing_newline(spark):
    r = parse(spark, "x\n1/4/26, 10:00 - Ana: a\nb\n\n1/4/26, 10:01 - Bo: c\n")
    assert [(x["line_start"], x["line_end"], x["content"]) for x in r] == [(2, 4, "a\nb\n"), (5, 5, "c")]
    w = parser.warnings(parser.log_lines(spark.createDataFrame([("z", "x\n1/4/26, 10:00 - Ana: a")], "source_zip string, text string"))).collect()
    assert [x["line_no"] for x in w] == [1]


def test_edited_deleted_empty(spark):
    r = parse(spark, "1/4/26, 10:00 - Ana: hey <This message was edited>\n1/4/26, 10:00 - Ana: You deleted this message\n1/4/26, 13:38 - Ana:")
    assert r[0]["edited"] and r[0]["content"] == "hey" and r[1]["type"] == "deleted" and r[2]["content"] == "" and r[2]["sender"] == "Ana"


@pytest.mark.parametrize(("stamp", "want"), [("1/2/26, 2:30 PM", "14:30:00"), ("1/2/26, 12:30 AM", "00:30:00"), ("1/2/26, 12:30 PM", "12:30:00")])
def test_half_days(spark, stamp, want):
    assert parse(spark, f"{stamp} - Ana: x")[0]["timestamp"] == f"2026-01-02T{want}"


def test_formats(spark):
    fmt = lambda t: parser.detect_formats(parser.log_lines(spark.createDataFrame([("z", t)], "source_zip string, text string"))).first()["date_format"]
    assert fmt("25/03/2026, 1:00 - a: b") == "DD/MM" and fmt("3/25/26, 1:00 - a: b") == "MM/DD" and fmt("1/2/26, 1:00 - a: b") == "MM/DD"
    assert fmt("1/2/26, 1:00 - protegidas com a criptografia de ponta a ponta") == "DD/MM"


def test_empty_and_null_logs(spark):
    logs = spark.createDataFrame([("a", None), (None, "x"), ("b", "")], "source_zip string, text string")
    assert parser.parse_lines(parser.log_lines(logs)).count() == 0
    assert parser.parse_lines(parser.log_lines(logs.limit(0))).count() == 0


def test_long_log_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(parser, "SLICE", 3)
    text = "\n".join(f"1/4/26, 10:{i:02d} - Ana: m{i}\nx\ny\nz" for i in range(20))
    r = parse(spark, text)
    assert [x["pos"] for x in r] == list(range(1, 21)) and all(x["content"] == f"m{i}\nx\ny\nz" for i, x in enumerate(r))


def test_scalar_helpers(spark):
    assert one(spark, "  a\n", js_trim) == "a"
    assert one(spark, "a-b-c", lambda c: remove_first(c, "-")) == "ab-c"
    assert one(spark, "in/WhatsApp Chat with Ana.zip", chat.contact_from_zip) == "Ana"
    assert one(spark, "Conversa do WhatsApp com Zé (1).ZIP", chat.contact_from_zip) == "Zé (1)"
    assert one(spark, " ..a/b:?c. ", chat.sanitize_name) == "a_b_c" and len(one(spark, "x" * 250, chat.sanitize_name)) == 200
    assert one(spark, 75.26, chat.clock, "double") == "01:15.26" and one(spark, None, chat.clock, "double") == "--:--"
    keys = {one(spark, s, sender_key) for s in ("~ Héllo  Bo", "‎hello bo ", "HÉLLO BO")}
    assert keys == {"hello bo"} and one(spark, " ", sender_key) is None


@pytest.mark.parametrize(
    ("day", "interval", "want"),
    [
        ("2026-02-25", "1w", "2026.02.23-2026.03.01"), ("2026-01-12", "2w", "2026.01.05-2026.01.18"), ("2026-01-19", "2w", "2026.01.19-2026.02.01"),
        ("2024-12-31", "2w", "2024.12.30-2025.01.12"), ("2025-01-06", "2w", "2025.01.06-2025.01.19"), ("2028-02-29", "1mo", "2028.02.01-2028.02.29"),
        ("2026-08-20", "3mo", "2026.07.01-2026.09.30"), ("2026-06-15", "1y", "2026.01.01-2026.12.31"), ("2026-25-03", "1y", "2028.01.01-2028.12.31"),
    ],
)
def test_periods(spark, day, interval, want):
    assert one(spark, day + "T10:00:00", lambda c: period_label(lenient_date(c), interval)) == want


def test_boundaries(spark):
    got = one(spark, "2026-01-01", lambda c: period_boundaries(F.to_date(c), F.date_add(F.to_date(c), 20), "1w"))
    assert len(got) == 4 and got[0].startswith("2025.12.29")


def test_dedup_fold_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        for p in range(rng.randint(1, 6)):
            kind = rng.choice(["text", "omitted", "media"])
            rows.append(("z", g * 10 + p, f"t{g}", "a", rng.choice("xy") if kind == "text" else "", f"f{rng.randint(0, 1)}" if kind == "media" else None, kind == "omitted"))
    df = spark.createDataFrame(rows, "source_zip string, pos int, timestamp string, sender string, content string, media_file string, is_media_omitted boolean")
    ids = {r["pos"]: r["message_id"] for r in dedup.with_id(df).collect()}
    for policy in dedup.POLICIES:
        want = []
        for g in range(60):
            group = [(r[1], ids[r[1]], r[5] is not None, r[6]) for r in rows if r[2] == f"t{g}"]
            want += first_of_each([(p, i, g, m, o) for p, i, m, o in group], policy)
        got = [(r["slot"], r["pos"]) for r in dedup.dedup_archive(df, policy).collect()]
        assert sorted(got) == sorted(want)


def test_dedup_policies():
    text, media, om = (1, "t", False, False), (2, "m", True, False), (3, "o", False, True)
    assert dedup.fold_group([om, (4, "m", True, False)]) == [(3, 4)] and dedup.fold_group([media, om]) == [(2, 2)]
    assert dedup.fold_group([text, text]) == [(1, 1)]
    both = [om, (4, "m", True, False), (5, "n", True, False)]
    assert dedup.fold_group(both) == [(3, 5)] and dedup.fold_group(both, "omitted_only") == [(3, 4), (5, 5)]


def test_merge(spark):
    cols = "message_id string, contact string, seq long, timestamp string, sender string, media_file string, is_media_omitted boolean"
    index = spark.createDataFrame([("a", "C", 1, "t1", "s", None, True), ("b", "C", 2, "t2", "s", None, False), ("x", "D", 1, "t9", "s", None, False)], cols)
    new = spark.createDataFrame([("m", 1, "t1", "s", "f", False), ("b", 2, "t2", "s", None, False), ("x", 3, "t9", "s", None, False), ("n", 4, "t3", "s", None, False)], "message_id string, slot int, timestamp string, sender string, media_file string, is_media_omitted boolean")
    acts = store.merge_archive(index, new, "C", "omitted_only")
    got = sorted((r["action"], r["pos"], r["seq"]) for r in acts.collect() if r["action"] != "deleted")
    assert got == [("added", 4, 3), ("skipped", 2, None), ("skipped", 3, None), ("upgraded", 1, 1)]


def merged_one_by_one(index, archives, policy):
    """A plain model of merging: archives one after another, messages one after another, over dicts.

    index: id -> row; row: contact, seq, key, media, omitted. Returns the index and what was done.
    """
    index, done = {k: dict(v) for k, v in index.items()}, {}
    for archive, contact, rows in archives:
        seqs = [r["seq"] for r in index.values() if r["contact"] == contact]
        top, match = max(seqs, default=0), {}
        for rid, r in sorted(index.items(), key=lambda kv: kv[1]["seq"]):
            if r["contact"] == contact and not (r["key"] in match and match[r["key"]][1]["media"]):
                match[r["key"]] = (rid, r)
        for pos, rid, key, media, omitted in rows:
            if rid in index:
                done[archive, pos] = "skipped"
                continue
            had = match.get(key)
            row = {"contact": contact, "key": key, "media": media, "omitted": omitted, "from": (archive, pos)}
            if had and media and not had[1]["media"] and (policy == "reference" or had[1]["omitted"]):
                del index[had[0]]
                if "from" in had[1]:
                    done[had[1]["from"]] = "replaced"
                row["seq"], done[archive, pos] = had[1]["seq"], "upgraded"
            elif had and omitted and had[1]["media"]:
                done[archive, pos] = "skipped"
                continue
            else:
                top += 1
                row["seq"], done[archive, pos] = top, "added"
            index[rid] = row
            match[key] = (rid, row)
    return index, done


@pytest.mark.parametrize("policy", dedup.POLICIES)
def test_merge_matches_a_plain_model(spark, policy):
    rng = random.Random(8)
    cols = "message_id string, contact string, seq long, archive int, slot int, timestamp string, sender string, media_file string, is_media_omitted boolean"

    def rows_of(contact, n):
        out = []
        for pos in range(1, n + 1):
            kind, key = rng.choice(["text", "media", "omitted"]), f"t{rng.randint(0, 5)}"
            out.append((pos, f"{key}{kind}{rng.choice(['', contact])}{rng.randint(0, 3)}", key, kind == "media", kind == "omitted"))
        return out

    for _ in range(3):
        index, seqs = {}, {"A": 0, "B": 0}
        for _, rid, key, media, omitted in rows_of("A", 6) + rows_of("B", 6):
            c = rng.choice("AB")
            if rid not in index:
                seqs[c] += 1
                index[rid] = {"contact": c, "seq": seqs[c], "key": key, "media": media, "omitted": omitted}
        archives = [(k, c, rows_of(c, 14)) for k, c in enumerate("ABACB", 1)]
        want, done = merged_one_by_one(index, archives, policy)
        old = spark.createDataFrame([(i, r["contact"], r["seq"], None, None, r["key"], "s", "f" if r["media"] else None, r["omitted"]) for i, r in index.items()], cols)
        new = spark.createDataFrame([(i, c, None, k, p, key, "s", "f" if m else None, o) for k, c, rows in archives for p, i, key, m, o in rows], cols)
        acts = store.merge_archives(old, new, policy).collect()
        assert {(r["archive"], r["pos"]): r["action"] for r in acts if r["archive"] is not None} == done
        assert {(r["contact"], r["seq"]) for r in acts if r["action"] == "deleted"} == {(r["contact"], r["seq"]) for i, r in index.items() if "from" in want.get(i, {"from": 1})}
        placed = {(r["archive"], r["pos"]): r["seq"] for r in acts if r["action"] in ("added", "upgraded")}
        assert placed == {r["from"]: r["seq"] for r in want.values() if "from" in r}
        after = store.apply_merge(old.select("message_id", "contact", "seq", "timestamp", "sender", "media_file"), new.drop("seq"), spark.createDataFrame(acts, "contact string, archive int, pos long, action string, seq long"))
        assert {(r["message_id"], r["contact"], r["seq"]) for r in after.collect()} == {(i, r["contact"], r["seq"]) for i, r in want.items()}


def first_of_each(rows, policy):
    """A plain model of dedup within one archive. rows: (pos, id, key, media, omitted) in order."""
    seen, out, omitted_at = set(), [], {}
    for pos, rid, key, media, omitted in rows:
        if rid in seen:
            continue
        if omitted:
            if any(o[1][2] == key and o[1][3] for o in out):
                continue
            omitted_at[key] = len(out)
            out.append((pos, (pos, rid, key, media, omitted)))
        elif media and key in omitted_at:
            k = omitted_at[key] if policy == "reference" else omitted_at.pop(key)
            seen.discard(out[k][1][1])
            out[k] = (out[k][0], (pos, rid, key, media, omitted))
        else:
            out.append((pos, (pos, rid, key, media, omitted)))
        seen.add(rid)
    return sorted((slot, r[0]) for slot, r in out)


def test_resolve_contacts(spark):
    cols = "message_id string, source_zip string, slot int"
    index = spark.createDataFrame([("a", "Ana"), ("b", "Ana"), ("x", "Xi")], "message_id string, contact string")
    new = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "1", 3), ("c", "2", 1), ("d", "2", 2), ("x", "3", 1), ("y", "3", 2), ("z", "3", 3), ("w", "3", 4)], cols)
    info = spark.createDataFrame([("1", 1, "Ana (1)"), ("2", 2, "Ann"), ("3", 3, "Zed")], "source_zip string, zip_order int, contact_name string")
    # the second archive follows the first, which went to Ana; a quarter isn't enough for the third
    assert store.resolve_contacts(index, new, info) == {"1": "Ana", "2": "Ana", "3": "Zed"}


def test_merge_query_holds_every_contact(spark, tmp_path):
    cols = "message_id string, seq long, timestamp string, sender string, contact string, type string, media_file string, source_zip string"
    rows = [("a1", 1, "t1", "s", "A", "media", None, "A.zip"), ("a2", 2, "t2", "s", "A", "text", None, "A.zip"), ("a3", 3, "t3", None, "A", "text", None, "A.zip")]  # the busiest
    rows += [("b1", 1, "t1", "s", "B", "media", None, "B.zip"), ("b2", 1, "t1", "s", "B", "media", "f.jpg", "B (1).zip"), ("b3", 2, "t2", "s", "B", "text", None, "B (1).zip")]
    rows += [("b4", 3, "t4", "s", "B", "text", None, "B.zip"), ("b4", 3, "t4", "~ s", "B", "text", None, "B (1).zip")]  # one message
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "messages.parquet"))
    spark.createDataFrame([("B.zip", 1), ("B (1).zip", 2)], "source_zip string, zip_order int").write.parquet(str(tmp_path / "archives.parquet"))
    got = {(r["contact"], r["action"], r["pos"], r["seq"]) for r in queries.queries()["merge_upsert_media"](spark, str(tmp_path)).collect()}
    assert got == {("B", "deleted", None, 1), ("B", "upgraded", 1, 1), ("B", "added", 2, 4), ("B", "skipped", 3, None)}


def test_contact_facts(spark):
    p = spark.createDataFrame([("A", "me"), ("A", "x"), ("B", "me"), ("B", None), ("B", "")], "contact string, sender string")
    assert store.detect_self(p).first()["self_name"] == "me"
    assert store.detect_self(p.filter("contact = 'A'")).count() == 0 and store.detect_self(p.limit(0)).count() == 0
    m = spark.createDataFrame([("z", "text", "a", "x"), ("z", "text", "b", "x"), ("z", "text", "c", None), ("y", "system", "", "Ana added you")], "source_zip string, type string, sender string, content string")
    assert {r["source_zip"]: r["is_group"] for r in store.group_test(m).collect()} == {"z": True, "y": True}
