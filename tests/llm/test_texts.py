import random
import textwrap
import unicodedata

import pytest

from chatloom.llm import encodings as E
from chatloom.llm import evaluation_leaks as L
from chatloom.llm import mixing as X
from chatloom.llm import personal_data as D
from chatloom.llm import sentences as N

TEXTS = ["pode conferir hoje à…", "não consigo ir amanhã", "você pode conferir a lâmpada", "SÃO 30 VAGAS, ATENÇÃO", "o café está à mesa", "Âncora do barco 👍", "plain text", "£ 3 e 30 €"]


def test_garbled_round_trip(spark):
    clean = [(k, t, "x") for k, t in enumerate(TEXTS * 30)]
    bad, k = {}, 1000
    for t in TEXTS:
        for wrong in ("cp1252", "cp1251", "cp437", "latin-1", "mac_roman"):
            try:
                g = t.encode("utf-8").decode(wrong)
            except UnicodeDecodeError:
                continue
            if g != t:
                bad[k] = (g, t)
                k += 1
                try:
                    bad[k] = (g.encode("utf-8").decode("cp1252"), t)
                    k += 1
                except UnicodeDecodeError:
                    pass
        if not t.isascii() and all(ord(c) < 256 for c in t):
            bad[k] = (t.encode("latin-1").decode("utf-8", "replace"), t)
            k += 1
    df = spark.createDataFrame([*clean, *[(i, g, "x") for i, (g, _) in bad.items()], (None, "Ã£", "x"), (5000, None, "x"), (5001, "", "x")], "row_id long, content string, restored string")
    got = {r["row_id"]: r["restored"] for r in E.restore(df).collect()}
    missed = set(bad) - set(got)
    assert set(got) <= set(bad) and len(missed) <= 0.05 * len(bad), [bad[i] for i in missed]
    right = sum(got.get(i) == t for i, (_, t) in bad.items())
    assert right >= 0.85 * len(bad), [(got.get(i), t) for i, (_, t) in bad.items() if got.get(i) != t]
    assert E.restore(df.limit(0)).count() == 0



def test_lone_leads_are_found(spark):
    bad = ["chego Ã s 19:20", "hoje Ã noite", "vejo isso ontem Ã  tarde", "vou Ã", "a saÃda fica ao lado", "lÃ estava"]
    good = ["É hoje", "hoje É dia", "a ÓPERA", "AMANHÃ NÃO", "MAÇÃ e pão", "Ônibus", "LETRA Ã NOVA", "на В поле"]
    rows = list(enumerate(bad + good)) + [(100 + k, "a saída fica ao lado") for k in range(5)]
    got = {r["row_id"]: r for r in E.restore(spark.createDataFrame(rows, "row_id long, content string")).collect()}
    assert set(got) == set(range(len(bad))), set(got) ^ set(range(len(bad)))
    assert got[4]["restored"] == "a saída fica ao lado" and not got[0]["complete"] and not got[3]["complete"]


def test_wildcards_keep_the_lead_byte(spark):
    """A lone lead byte tells which block the lost letter is of: not the most frequent word, but the one that fits."""
    clean = [(k, "x", t) for k, t in enumerate(["o pœo veio"] * 9 + ["o pão veio"] * 3 + ["a maçã ficou"] * 3)]
    rows = [*clean, (100, "x", "o p\u00c3o veio"), (101, "x", "o p\ufffdo veio"), (102, "x", "o p\u00c5o veio")]
    got = {r["row_id"]: r["restored"] for r in E.restore(spark.createDataFrame(rows, "row_id long, source_zip string, content string")).collect()}
    assert got[100] == "o pão veio" and got[101] == got[102] == "o pœo veio"
    import re as _re

    assert _re.match(E.wildcard_pattern("p" + chr(E.LEAD + 0xC3) + "o").replace("\\x{c0}", "\u00c0").replace("\\x{ff}", "\u00ff"), "pão")


def test_stated_encoding_and_repeated_ids(spark):
    rows = [(k, "bad", f"Ã¡rea {k}") for k in range(3)] + [(100 + k, "good", "área limpa") for k in range(200)] + [(500, "bad", "b Ã£"), (500, "bad", "a Ã£"), (501, None, "Ã£ sem arquivo")]
    archives = spark.createDataFrame([("bad", "latin-1"), ("bad", None), ("good", "utf-8")], "source_zip string, encoding string")
    df = spark.createDataFrame(rows, "row_id long, source_zip string, content string")
    got = {r["row_id"]: r["restored"] for r in E.restore(df, archives=archives).collect()}
    assert got[0] == "área 0" and {0, 1, 2} <= set(got) and not set(range(100, 300)) & set(got) and got.get(500) in (None, "a ã", "a Ã£")
    assert E.restore(df.limit(0), archives=archives).count() == 0


def test_long_token_is_linear():
    assert E.repair("Ã£" * 20_000, {"ã": -1.0}, -12.0)[0] == "ã" * 20_000


def test_myers_matches_brute_force():
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (8, 20))
        assert L.myers(p, t) == brute(p, t)


def test_leaks(spark):
    words = "um bando de gansos cinzentos às pressas pendurou lanternas de papel vegetal no telhado da biblioteca em silêncio".split()
    item = " ".join(words)
    ja = "凍った谷のパン屋は息が切れるまで段を数え手探りで見捨てられた風車のそばで"
    docs = {
        1: "antes " + " ".join(words[2:14]) + " depois", 2: " ".join(words[2:13]) + " depois", 3: "X" + unicodedata.normalize("NFD", item).upper().replace(" ", "\n- "), 4: "gan​sos",
        5: ja[3:27], 6: ja[3:26], 7: item.replace("lanternas", "lanternaz"), 8: None, 9: "", 10: "a" * 200_000, 11: " ".join(words[1:12]) + " papelx",
    }
    df = spark.createDataFrame([(k, t, 0) for k, t in docs.items()] + [(1, docs[1], 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, ja), (3, "curto"), (4, None), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in L.find_leaks(df, items).collect()}
    assert {k for k, d in got.items() if d == 0} == {(1, 1), (3, 1), (5, 2)} and got[7, 1] == 1
    assert {(r["doc_id"], r["item_id"]) for r in L.find_leaks(df, items, block=1).collect()} == set(got)
    assert L.find_leaks(df, items.limit(0)).count() == 0 and L.find_leaks(df.limit(0), items).count() == 0


def test_one_edit_is_always_found():
    """Every window of twelve words with one edit, at every offset and of every kind, and none with three."""
    import ahocorasick

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    for errors in (1, 2):
        it = L.Item(1, " ".join(words), 12, 24, errors)
        auto = ahocorasick.Automaton()
        for piece, at in it.pieces():
            auto.add_word(piece, (len(piece), [(0, at)]))
        auto.make_automaton()
        for _ in range(1500):
            k = rng.randint(0, len(words) - 12)
            part = words[k : k + 12]
            for _ in range(rng.randint(0, errors)):
                n = rng.randrange(12)
                w = part[n]
                p = rng.randrange(len(w))
                part[n] = rng.choice([w[:p] + "z" + w[p + 1 :], w[:p] + "z" + w[p:], w[:p] + w[p + 1 :]])
            text = " ".join(["Yx", *part, "Yz"])
            assert 0 in L.leaks_of(text, [it], auto, errors), (errors, k, part)
        for _ in range(300):
            k = rng.randint(0, len(words) - 12)
            part = [w if n % 3 else "Q" + w[1:] + "Q" for n, w in enumerate(words[k : k + 12])]
            assert not L.leaks_of(" ".join(part), [it], auto, errors)


def test_letters_are_those_of_the_stream():
    rng = random.Random(3)
    alphabet = "aÁçß İıñ_-–“”…º½ﬁ漢カﾞが\u0301\u200b9٣Ω\n€"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        assert L.letters(t) == L.stream(t)[0], t


def test_water_fill():
    got = X.water_fill({"a": (0.5, 100, 1), "b": (0.3, 1000, 1), "c": (0.2, 10, 3), "d": (0.0, 50, 1)}, 600)
    assert got["a"] == 100 and got["c"] == 30 and abs(got["b"] - 470) < 1e-6 and got["d"] == 0
    exact = X.water_fill({"a": (0.5, 100, 1), "b": (0.5, 1000, 1)})
    assert exact == {"a": 100.0, "b": 100.0} and X.water_fill({}) == {} and X.water_fill({"a": (1.0, 0, 2)}) == {"a": 0.0}
    assert X.water_fill({"a": (0.4, 100, 1), "b": (0.4, 50, 2), "none": (0.2, 0, 3), "never": (0.1, 9, 0)}) == {"a": 100.0, "b": 100.0, "none": 0.0, "never": 0.0}


def test_mix(spark):
    rows = [(k, "big" if k % 10 else "small", "palavra " * (1 + k % 7)) for k in range(400)] + [(None, "big", "x"), (900, None, "x"), (901, "big", None), (902, "other", "x"), (903, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    out, report = X.mix(docs, targets)
    out, rep = out.collect(), {r["source"]: r for r in report.collect()}
    assert abs(rep["big"]["share"] - 0.7) < 0.02 and max(r["copies"] for r in out if r["source"] == "small") <= 2 and all(r["copies"] == 1 for r in out if r["source"] == "big")
    assert rep["small"]["taken"] == sum(r["tokens"] * r["copies"] for r in out if r["source"] == "small") and rep["absent"]["taken"] == 0
    again = {(r["doc_id"], r["copies"]) for r in X.mix(docs, targets)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}
    assert X.mix(docs.limit(0), targets)[0].count() == 0 and X.mix(docs, targets.limit(0))[0].count() == 0


@pytest.mark.parametrize(
    "parts",
    [
        ["O Dr. Silva chegou.", "Ela saiu às 18h45."], ["Custa R$ 3.50, i.e. pouco.", "Ok!"], ['"Não vou. Já disse!", respondeu ela.', "Fim."], ["Trouxeram pregos, fios etc.", "O gato dormiu?"],
        ["A obra do bloco B.", "Assinou A. T. Zand, às 11h."], ["「行きません。もう。」と言いました。", "（はい。）", "本当に……そうです！"], ["她问：“谁来？”然后走了。", "好！"], ["ราคา 8.4 บาทครับ", "เราได้รับ 30 ชิ้นแล้วครับ"],
        ["«لن أذهب. قلت ذلك!» هكذا أجاب.", "من رأى؟"], ["डॉ. राम आए।", "ठीक है।"], ["Niemand kam am 9. Mai!", "Der Hof war leer."], ["Sério…", "A casa caiu."], ["Ele falou... bom, chega.", "Sim."],
    ],
)
def test_sentences(parts):
    text = " ".join(parts) if not any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in parts[0]) else "".join(parts)
    assert [text[a:b] for a, b in N.Splitter().sentences(text)] == parts


def test_layout():
    flat = "A imagem mostra a lâmpada do poço da vizinha na oficina, e nada mais foi visto ali. O orçamento do telhado da obra voltou sem avisar na terça de manhã, conforme o registro da portaria."
    wrapped = textwrap.fill(flat, 72)
    chat = "[13/11/2025, 09:22:57] Ana: oi. Tudo bem?\r\n> 1. Sim\r\n\r\n# Título\n- item"
    got = lambda t: [t[a:b] for a, b in N.Splitter().sentences(t)]
    assert got(wrapped) == [wrapped[: wrapped.index(" O orç")], wrapped[wrapped.index("O orç") :]]
    assert got(chat) == ["[13/11/2025, 09:22:57] Ana: oi.", "Tudo bem?", "> 1. Sim", "# Título", "- item"]
    assert got("") == got(" \n ") == [] and len(got("a. B" * 100_000)) >= 1


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "A. B", 0), (1, "A. B", 0), (2, None, 0), (None, "x", 0), (3, "", 0)], "doc_id long, text string, start_char int")
    assert N.split_sentences(df).count() in (2, 4) and N.split_sentences(df.limit(0)).count() == 0


def test_personal_data(spark):
    names = [(f"{g} {f}",) for g in ("Elisa", "Igor", "Graça") for f in ("Tormirra", "Velquito", "Norbique")]
    senders = spark.createDataFrame([*names, ("~ ELISA TORMIRRA",), (None,), ("",), ("speaker_0",)], "who string")
    lines = {
        "email": ["manda para ana.b@example.com já", "é ana_b arroba example ponto net", "write to x at mail dot example, ok", "JO@POSTA.TEST"],
        "phone": ["me liga no +55 (30) 98491-5255", "me liga no 5530984915255", "me liga no três zero nove oito quatro nove um cinco dois cinco cinco"],
        "id_number": ["o CPF é 895.158.655-32 viu", "o CPF é 89515865532 viu", "documento ZQ833996 em anexo"],
        "address": ["moro na rua do Barro Fino, 2540", "leave it at 1005 Copper Kettle St. by 8pm", "vivo en Calle de los Olmos nº 12"],
        "name": ["falei com Igor ontem", "avisa elisa tormirra que atrasou", "@⁨Graça Velquito⁩ veio", "quem foi El​isa"],
        "": ["código do rastreio 0437539497", "o processo 1207453-59.2025.8.99.0331 andou", "que sem graça, chega", "a Rua do Lago fechou", "te aviso @ 11:40", "total de R$ 40.846,20", "", None],
    }
    rows, want, k = [], set(), 0
    for rep in range(4):
        for kind, texts in lines.items():
            for t in texts:
                rows.append(("parsed" if rep % 2 else "utterances", k, t, "clash"))
                if kind:
                    want.add((k, kind))
                k += 1
    df = spark.createDataFrame([*rows, ("parsed", None, "ana@b.com", "x"), ("parsed", 9999, "x-" * 50_000 + "@", "x")], "src string, row_id long, text string, kind string")
    got = {(r["row_id"], r["kind"]) for r in D.find_personal_data(df.drop("kind"), senders).collect()}
    assert got == want, (got - want, want - got, rows)
    red = {r["row_id"]: r["redacted"] for r in D.redact(df, senders).collect()}
    assert red[0] == "manda para [EMAIL] já" and not any(v is None for v in red.values())
    assert D.find_personal_data(df.limit(0), senders.limit(0)).count() == 0


def test_seed_words_broadcast_or_joined(spark):
    names = [(f"{g} {f}",) for g in ("Elisa", "Igor", "Graça") for f in ("Tormirra", "Velquito", "Norbique")]
    senders = spark.createDataFrame(names, "who string")
    lines = ["falei com Igor ontem", "avisa elisa tormirra que atrasou", "a conta é de el\ufffdsa", "GraÃ§a Velquito veio; ana@b.com", "quem viu Elisa Norbique e Igor?", "que sem graça", "Tormirra 55 123"]
    texts = spark.createDataFrame([("parsed", k, t) for k, t in enumerate(lines * 2)] + [("parsed", 0, "outro Igor")], "src string, row_id long, text string")
    seeds = D.cut(D.seed_words(senders))
    whole = sorted(map(str, D.mentions(texts, seeds).collect()))
    assert len(whole) > 10
    for most in (0, 3):
        assert sorted(map(str, D.mentions(texts, seeds, most).collect())) == whole


def test_a_number_known_in_one_row_is_known_in_all(spark):
    lines = ["o CPF é 89515865532 viu"] * 3 + ["o CPF é 895.158.655-32 viu"] * 3 + ["vai 89515865532 sim", "vai 99915865532 sim"]
    texts = spark.createDataFrame([("parsed", k, t) for k, t in enumerate(lines)], "src string, row_id long, text string")
    got = {(r["row_id"], r["kind"]) for r in D.find_personal_data(texts, spark.createDataFrame([], "who string")).collect()}
    assert got == {(k, "id_number") for k in range(7)}


def test_a_repeated_text_is_searched_once(monkeypatch):
    plain, searched = D.Finder.mentions, []
    monkeypatch.setattr(D.Finder, "mentions", lambda self, t, fillers=True: searched.append(t) or plain(self, t, fillers))
    finder = D.Finder({"igor"}, {"velquito"})
    lines = ["falei com Igor hum ontem", "ana@b.com, +55 (30) 98491-5255", "nada", "x" * 1000 + " Igor"]
    rows = [(src, k, t) for k, (src, t) in enumerate((src, t) for _ in range(3) for src in ("parsed", "utterances") for t in lines)]
    got = [m for r in rows for m in D._row_mentions(finder, *r)]
    assert got == [(src, k, *m) for src, k, t in rows for m in plain(finder, t, src != "parsed")] and len(got) == 24
    # once for each way of reading; long texts aren't kept
    assert [searched.count(t) for t in lines] == [2, 2, 2, 6]
    monkeypatch.setattr(D, "KEPT", 2)
    finder = D.Finder({"igor"}, {"velquito"})
    assert [m for r in rows for m in D._row_mentions(finder, *r)] == got and len(finder.kept) <= 2


def test_searches_that_skip_equal_the_plain_ones():
    bits = ["Ana", "joão", "el\ufffdsa", "\ufffd", "_", "a_b", "-", "Ana-Maria", "d'Ávila", "’", "İ", "ſt", "ß", "Ω", "ж", "山", "e\u0301", "\u200b", "Ã©", "1a", "²", "１２", "123 456", "12.34-56", "1234567", " ", "\n", ", "]
    word = D.re.compile(r"[^\W\d_](?:[\w'’\ufffd]|-(?=\w))*|\ufffd[\w\ufffd]*")
    upper = D.re.compile(r"(?<!\w)[^\W\d_a-zß-öø-ÿ]\w|\ufffd")
    number = D.re.compile(r"\d(?:[\s.()\-]{0,2}\d){5}|\d{6}")
    base = {ord(c): b for c, b in D._TABLE.items()}
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 9)))
        folded = t.lower().translate(base)
        assert D._fold(t) == folded and D._tokens(t) == set(D._TOKEN.findall(folded)), t
        assert [m.span() for m in D._WORD.finditer(t)] == [m.span() for m in word.finditer(t)], t
        assert ("\ufffd" in t or bool(D._UPPER.search(t))) == bool(upper.search(t)), t
        assert bool(D._LONG_NUMBER.search(t)) == bool(number.search(t)), t
        if D._MOJIBAKE.search(t) or D._INVIS.search(t) or D._MARKS.search(t):
            assert D._SUSPECT.search(t), t


def test_wrapped_to_any_width():
    words = "a obra do telhado da vizinha parou porque a chuva voltou sem avisar e ninguém trouxe a lona que estava na garagem desde o mês passado".split()
    flat = (" ".join(words) + ". ") * 3
    flat = flat.replace(". a", ". A").strip()
    flat = flat[0].upper() + flat[1:]
    got = lambda t: [" ".join(t[a:b].split()) for a, b in N.Splitter().sentences(t)]
    for width in (24, 40, 49, 72, 131, 200):
        assert len(got(textwrap.fill(flat, width))) == 3, width
    chat = "chego às 9:40, me espera\npor que não avisaram?\nok\nrosa ou azul?"
    assert len(got(chat)) == 4
    ja = "記録によると段を数えた人は倉庫にいました。今夜受付で待ちますと言いました。明日の朝また来るそうです。"
    assert len(got("\n".join(ja[k : k + 9] for k in range(0, len(ja), 9)))) == 3
    assert len(got("请带54个合同副本\n请在会议室等我吧\n请带61个走廊灯泡\n请在院子等我吧好")) == 4


def test_long_thai_runs_and_opening_words():
    s = N.Splitter({"ประตูโรงรถ", "เครื่องสูบน้ำ"})
    got = lambda t: [t[a:b] for a, b in s.sentences(t)]
    long = "ใครเห็นประตูโรงรถ" * 40
    assert got(f"{long}ไหมคะ เราได้รับแล้วครับ") == [f"{long}ไหมคะ", "เราได้รับแล้วครับ"]
    assert got("เครื่องสูบน้ำเสียแล้ว แต่ประตูโรงรถไม่เสีย") == ["เครื่องสูบน้ำเสียแล้ว", "แต่ประตูโรงรถไม่เสีย"]
    assert len(got("เครื่องสูบน้ำเสียแล้ว ประตูโรงรถไม่เสีย")) == 1
    assert got("「もう言いました。」とても静かでした。") == ["「もう言いました。」とても静かでした。"]


def test_corpus_dictionary(spark):
    texts = [(k, f"{a}{b}{c}") for k, (a, b, c) in enumerate((a, b, c) for a in ("倉庫", "受付", "会議室") for b in ("修理", "契約書") for c in ("確認", "連絡", "準備"))]
    got = {r["word"] for r in N.corpus_dictionary(spark.createDataFrame(texts, "doc_id long, text string"), count=4, neighbours=2).collect()}
    assert {"修理", "契約書", "確認", "倉庫"} <= got and not {"庫修", "書確", "理確認"} & got


def test_lattice_path_is_the_best_of_all():
    import itertools

    rng = random.Random(2)
    s = N.Splitter()
    for _ in range(200):
        p = "".join(rng.choice(["Ana", "b", "Dr", "etc", "A", " ", " ", ". ", "! ", "(", ")", '"', "9"]) for _ in range(rng.randint(3, 22))) + "Z"
        nodes = list(s._nodes(p, 0))
        if len(nodes) > 9:
            continue

        def value(cuts, p=p, nodes=nodes):
            total, at = 0.0, 0
            for j, score, bracket in [*(n for n in nodes if n[0] in cuts), (len(p), 0.0, -1)]:
                if bracket >= 0 and (at > bracket or p[at:bracket].strip()):
                    return N.BROKEN
                total += score + (0.0 if bracket >= 0 or any(c.isalnum() for c in p[at:j]) else N.NO_WORD)
                at = j
            return total

        best = max(value({j for j, _, _ in part}) for n in range(len(nodes) + 1) for part in itertools.combinations(nodes, n))
        assert abs(value(set(s.boundaries(p, 0))) - best) < 1e-9, p
