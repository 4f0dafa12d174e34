import random

import pytest

from chatloom.llm import batches as B
from chatloom.llm import survivors as S

P = "row_id long, batch_no int, source_zip string, timestamp string, sender string, content string, type string, media_file string, is_media_omitted boolean, subtype string, minute string"
A = "source_zip string, contact_name string, exported_at timestamp, media_files array<string>"
O = "source_zip string, date_format string, timezone string"  # noqa: E741


def tables(spark, rows, archives=("z",), files=()):
    import datetime as dt

    p = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6] if len(r) > 6 else "text", r[7] if len(r) > 7 else None, len(r) > 7 and r[7] is None, None, "clash") for r in rows], P)
    a = spark.createDataFrame([(z, "chat", dt.datetime(2024, 1, k + 1), list(files)) for k, z in enumerate(archives)], A)
    return p, a, spark.createDataFrame([(z, None, "UTC") for z in archives], O)


T = "2024-01-01T10:00:30"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("olá, tudo bem?", "OLA tudo  bem 😂", True), ("o portão chegou", "o protão chegou", True), ("o portão chegou", "o portã chegou", True), ("o portão chegou", "o portao chegou (editada)", True),
        ("o portão da garagem chegou hoje cedo", "o portão da gar…", True), ("o portão da garagem chegou hoje cedo", "o portao da garagem che... Ler mais", True), ("ok", "o…", False),
        ("são 30 peças", "são 31 peças", False), ("não chegou ainda", "chegou ainda", False), ("chegou hoje", "chegou ontem", False), ("ab", "ac", False), ("", "", True), ("👍", "😂", True),
    ],
)
def test_same_content(spark, a, b, same):
    got = B.find_repeats(*tables(spark, [(1, 0, "z", T, "Ana", a), (2, 1, "z", T, "~ ANA", b)])).collect()
    assert [tuple(r) for r in got] == ([(1, 2)] if same else [])


def test_earliest_batch_and_ties(spark):
    rows = [(9, 0, "z", T, "a", "um texto"), (7, 0, "z", T, "a", "um texto"), (5, 1, "z", T, "a", "um texto"), (3, 2, "z", T, "a", "Um texto!"), (2, 2, "z", T, "b", "um texto"), (1, 3, "z", "2024-01-01T10:01:00", "a", "um texto")]
    rows += [(20, 1, "z", T, "a", None), (None, 1, "z", T, "a", "um texto"), (21, 1, "z", None, "a", "um texto"), (22, 1, "z", T, None, "um texto"), (23, 1, "zz", T, "a", "um texto"), (24, None, "z", T, "a", "um texto")]
    got = {tuple(r) for r in B.find_repeats(*tables(spark, rows)).collect()}
    assert got == {(7, 5), (7, 3)}
    assert B.find_repeats(*tables(spark, [])).count() == 0


def test_recall_against_brute_force(spark):
    rng = random.Random(3)
    words = "portão garagem chave obra gato água conta rua casa porta mesa pedra".split()
    rows, want = [], 0
    for k in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        i = rng.randrange(len(text))
        other = text[:i] + text[i + 1 :] if rng.random() < 0.5 else text[: max(4, len(text) * 2 // 3)] + "…"
        rows += [(2 * k, 0, "z", f"2024-01-01T{k // 60:02d}:{k % 60:02d}:00", "a", text), (2 * k + 1, 1, "z", f"2024-01-01T{k // 60:02d}:{k % 60:02d}:59", "a", other)]
        want += len(text.replace(" ", "")) >= 5
    assert len(B.find_repeats(*tables(spark, rows)).collect()) >= want


def by_batch(p, a, o):
    index, got = None, set()
    for b in sorted({r["batch_no"] for r in p.select("batch_no").distinct().collect()}):
        hits, index = B.ingest_batch(p.filter(f"batch_no = {b}"), index, a, o)
        got |= {tuple(r) for r in hits.collect()}
    assert got == {tuple(r) for r in B.find_repeats_by_batch(p, a, o).collect()}
    return got, index


def test_incremental_equals_at_once(spark):
    rows = [(k, k % 4, "z", f"2024-01-01T10:{k % 7:02d}:00", "a", f"texto numero {k % 5} da obra") for k in range(40)]
    p, a, o = tables(spark, rows)
    at_once = {tuple(r) for r in B.find_repeats(p, a, o).collect()}
    assert by_batch(p, a, o)[0] == at_once and at_once


def test_earliest_variant_of_the_first_batch(spark):
    """A slip inside batch 0 doesn't hide the message's earliest row; slash dates of one export in several batches."""
    stamp = "25/03/2024 10:00:30"
    rows = [(1, 0, "z", stamp, "a", "o pacote chegou"), (2, 0, "z", stamp, "a", "o pacote chegu"), (3, 1, "z", stamp, "a", "o pacote chegu")]
    t = tables(spark, rows)
    assert {tuple(r) for r in B.find_repeats(*t).collect()} == by_batch(*t)[0] == {(1, 3)}
    # the export is month first, which batch 0 shows; the copies of the later batches fit both orders
    rows = [(1, 0, "z", "3/25/2024 10:00:30", "a", "x"), (2, 0, "y", "2024-03-04 10:00:10", "a", "um texto longo"), (3, 1, "z", "3/4/2024 10:00:30", "a", "um texto longo"), (4, 2, "z", "3/4/2024 10:00:30", "a", "um texto longu")]
    t = tables(spark, rows, ("z", "y"))
    got, index = by_batch(*t)
    assert {tuple(r) for r in B.find_repeats(*t).collect()} == got == {(2, 3), (2, 4)} and index.held.count() == 0


def test_open_slash_dates_move_when_decided(spark):
    rows = [(1, 0, "z", "3/4/2024 10:00:30", "a", "um texto longo"), (2, 1, "z", "3/25/2024 09:00:00", "a", "outro"), (3, 2, "y", "2024-03-04 10:00:10", "a", "um texto longo")]
    t = tables(spark, rows, ("z", "y"))
    got, index = by_batch(*t)
    assert got == {tuple(r) for r in B.find_repeats(*t).collect()} == {(1, 3)} and index.held.count() == 0
    early = B.ingest_batch(t[0].filter("batch_no = 0"), None, *t[1:])[1]
    assert early.held.count() == 1 and early.classes.count() == 0


def test_one_scope_with_many_texts(spark):
    """All texts in one chat, sender and minute: blocks must find exactly the pairs that brute force finds."""
    rng = random.Random(9)
    words = "portão garagem chave obra gato água conta rua casa porta mesa pedra não 12 47".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(k, 0, "z", T, "a", t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts):
        i = rng.randrange(len(t))
        rows.append((100 + k, 1, "z", T, "a", [t[:i] + t[i + 1 :], t[:i] + "q" + t[i:], t[: max(5, len(t) // 2)] + "…", t[:7] + "…", t.upper()][k % 5]))
    p, a, o = tables(spark, rows)
    got = {tuple(r) for r in B.find_repeats(p, a, o).collect()}
    c = B.with_fingerprints(B.classes(B.message_rows(B.scoped_rows(B.text_rows(p), a, o, evidence=p))))
    x, y = c.alias("n"), c.alias("i")
    pairs = x.crossJoin(y).filter("n.class_id != i.class_id").filter(B.same_text("n", "i")).select("n.class_id", "i.class_id", "i.batch", "i.row_id").collect()
    best = {r["class_id"]: (r["batch"], r["row_id"]) for r in c.collect()}
    for n, _, batch, row in pairs:
        best[n] = min(best[n], (batch, row))
    of = {r["row_id"]: (r["class_id"], r["batch_no"]) for r in B.message_rows(B.scoped_rows(B.text_rows(p), a, o, evidence=p)).collect()}
    assert got == {(best[k][1], r) for r, (k, b) in of.items() if b > best[k][0]} and len(got) > 40


def test_survivors(spark):
    rows = [
        (1, 0, "a", T, "x", "leg", "media", "f.jpg"), (2, 0, "b", T, "~X", " legenda longa ", "media", None), (3, 0, "c", T, "X", "", "media", "F.JPG"), (4, 0, "c", T, "X", "", "media", "F.JPG"),
        (5, 0, "a", "2024-01-01T11:00:00", "x", "", "media", "g.jpg"), (6, 0, "b", "2024-01-01T11:00:00", "x", "", "media", "h.jpg"),  # two files, two messages
        (7, 0, "a", "2024-01-01T12:00:00", "x", "", "media", "gone.jpg"), (8, 0, "b", "2024-01-01T12:00:00", "x", "", "media", None),  # not listed
        (9, 0, "a", None, "x", "", "media", "f.jpg"), (10, 0, "a", T, None, None, "media", "f.jpg"),
    ]
    p, a, o = tables(spark, rows, ("a", "b", "c"), ("f.jpg", "g.jpg"))
    assert [tuple(r) for r in S.found(p, a, o).collect()] == [(1, 3, 2)]
    full = {r["first_row_id"]: r for r in S.survivors(p, a, o).collect()}
    assert full[1]["copies"] == 4 and full[1]["files"] == ["f.jpg"] and full[7]["media_row_id"] is None
    assert S.found(*tables(spark, [])).count() == 0


def test_survivors_keep_whole_captions(spark):
    one, two = "O portão da garagem abriu", "O portão da garagem fechou"
    rows = [(1, 0, "a", T, "x", one, "media", "f.jpg"), (2, 0, "b", T, "x", one[:22], "media", "f.jpg"), (3, 0, "c", T, "x", two, "media", "f.jpg")]
    u = "2024-01-01T11:00:00"  # two files whose captions agree in twelve letters
    rows += [(4, 0, "a", u, "x", one, "media", "f.jpg"), (5, 0, "b", u, "x", two, "media", "g.jpg"), (6, 0, "c", u, "x", two, "media", None), (7, 0, "c", u, "x", two[:24], "media", None)]
    p, a, o = tables(spark, rows, ("a", "b", "c"), ("f.jpg", "g.jpg"))
    r = S.media_rows(p, a, o).collect()
    captions = {x["row_id"]: x["caption"] for x in r}
    assert captions[1] == captions[2] == "oportaodagaragemabriu" and captions[3] == "oportaodagaragemfechou"
    full = {x["first_row_id"]: x for x in S.survivors(p, a, o).collect()}
    assert set(full) == {1, 5} and full[5]["copies"] == 3 and set(full[1]["captions"]) <= {one, two} and full[5]["captions"] == [two]
    assert (full[5]["content"], full[5]["media_file"], full[5]["is_media_omitted"]) == (two, "g.jpg", False)


def test_truths_learn_a_bad_source(spark):
    claims = [(f"g{k}", "file", "true", s) for k in range(30) for s in ("good", "ok")] + [(f"g{k}", "file", f"bad{k}", "liar") for k in range(30)]
    c = spark.createDataFrame(claims, "group_id string, field string, value string, source string")
    v, q = S.truths(c, c.select("group_id", "field", "source").distinct())
    assert v.filter("value like 'bad%' and p >= 0.5").count() == 0 and v.filter("value = 'true' and p < 0.5").count() == 0
    spec = {r["source"]: r["spec"] for r in q.collect()}
    assert spec["liar"] < spec["good"]


def test_truths_match_a_plain_model(spark):
    """The sums over asserted values only give what a loop over every source and value gives."""
    import math

    rng = random.Random(4)
    claims = {(f"g{rng.randint(0, 5)}", f"f{rng.randint(0, 2)}", rng.choice(["a", "b", "c" + S.LIST])) for _ in range(40)}
    cover = {(g, s) for g, _, s in claims} | {(f"g{k}", "c" + S.LIST) for k in range(6)}
    prior = lambda s: (S.LIST_SENSITIVITY, S.LIST_SPECIFICITY) if s.endswith(S.LIST) else (S.SENSITIVITY, S.SPECIFICITY)
    q = {s: tuple(x[0] / sum(x) for x in prior(s)) for _, s in cover}
    clip = lambda x: min(1 - 1e-4, max(1e-4, x))
    for _ in range(3):
        p = {}
        for g, v in {(g, v) for g, v, _ in claims}:
            odds = sum(math.log(q[s][0] / (1 - q[s][1]) if (g, v, s) in claims else (1 - q[s][0]) / q[s][1]) for h, s in cover if h == g)
            p[g, v] = 1 / (1 + math.exp(-odds))
        new = {}
        for s in q:
            mine = [(p[g, v], (g, v, s) in claims) for g, v in p if (g, s) in cover]
            (a, b), (c, e) = prior(s)
            new[s] = (clip((sum(x for x, y in mine if y) + a) / (sum(x for x, _ in mine) + a + b)), clip(1 - (sum(1 - x for x, y in mine if y) + e) / (sum(1 - x for x, _ in mine) + c + e)))
        q = new
    cl = spark.createDataFrame([(g, "file", v, s) for g, v, s in claims], "group_id string, field string, value string, source string")
    co = spark.createDataFrame([(g, "file", s) for g, s in cover], "group_id string, field string, source string")
    v, src = S.truths(cl, co, rounds=3, tolerance=0.0)
    assert all(abs(r["p"] - p[r["group_id"], r["value"]]) < 1e-9 for r in v.collect()) and all(abs(r["sens"] - q[r["source"]][0]) < 1e-9 for r in src.collect())


def test_an_unlisted_name_loses(spark):
    """A file that exports name but no archive holds is judged by its sources, one that is there is true."""
    rows = [(1, 0, "a", T, "x", "", "media", "gone.jpg"), (2, 0, "b", T, "x", "", "media", None), (3, 0, "a", "2024-01-01T11:00:00", "x", "", "media", "f.jpg"), (4, 0, "b", "2024-01-01T11:00:00", "x", "", "media", None)]
    p, a, o = tables(spark, rows, ("a", "b"), ("f.jpg",))
    got = {r["first_row_id"]: r for r in S.survivors(p, a, o).collect()}
    assert got[1]["media_row_id"] is None and got[1]["is_media_omitted"] and got[1]["media_file"] == "gone.jpg"
    assert got[3]["media_row_id"] == 3 and not got[3]["is_media_omitted"] and got[3]["files"] == ["f.jpg"]
