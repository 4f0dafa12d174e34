"""Personal information inside free text (problem 3).

Method: bootstrapped contextual extraction. Seed entities (names of senders and speakers; numbers
whose written form leaves no doubt) induce lexical patterns, the words left and right of them.
Spark scores a graph of patterns and instances in rounds: a pattern is as good as the share of its
labelled instances that are of its kind, an open instance takes the kind of its good patterns and
then votes for other patterns. Patterns of high confidence discover identifiers no seed names, and
a number found by its context in one row is known wherever else it stands. E-mail addresses and
street addresses are told by their form alone.

Scale: one Arrow pass turns texts into mentions; everything after that is aggregates over mentions.
Seed words are broadcast where they are few; else each text's words are joined with them in Spark,
with the same result. The graph holds distinct patterns, not rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE
from chatloom.llm.encodings import LOST, repair
from chatloom.llm.turns import WRITTEN, label_key
from chatloom.session import cut, small

#: A pattern counts from so many labelled instances on, at such a share of its kind.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.9, 2
#: Up to so many seed words are broadcast; more are joined with the texts' words.
SEED_WORDS = 200_000
#: Texts of up to so many characters often recur; the mentions of so many of them are kept per task.
KEPT_CHARS, KEPT = 300, 1 << 14
MENTION = "src string, row_id long, kind string, state string, shape string, l2 string, r2 string, key string, start int, end int"

# How at-sign and dot are spoken or hidden.
_AT = r"(?:\s?[@＠]\s?|\s*[\[(]\s?(?:at|arroba)\s?[\])]\s*|\s+(?:arroba|at)\s+)"
_DOT = r"(?:\s?\.\s?|\s*[\[(]\s?(?:dot|ponto|punto)\s?[\])]\s*|\s+(?:ponto|punto|dot)\s+)"
_LOCAL = r"[a-z0-9_%+-]{1,64}(?:(?:\.|\s+(?:ponto|punto|dot)\s+)[a-z0-9_%+-]{1,64}){0,8}"
_TLD = r"(?:com|net|org|edu|gov|info|io|co|br|pt|es|uk|us|de|jp|in|au|ar|mx|example|test|invalid|local|localhost|[a-z]{2,12})"
EMAIL = re.compile(rf"(?<![\w@]){_LOCAL}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}(?:[a-z0-9-]{{1,63}}{_DOT}){{0,8}}{_TLD})(?![\w@])", re.I)

# Words for digits.
DIGIT_WORDS = "zero um dois três tres quatro cinco seis sete oito nove meia uno una dos cuatro siete ocho nueve cero one two three four five six seven eight nine oh".split()  # noqa: SIM905
_DIGIT_TOKENS = set(DIGIT_WORDS)
_DW = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPOKEN = re.compile(rf"(?<!\w)(?:(?:{_DW})[\s,.-]+){{6,}}(?:{_DW})(?!\w)", re.I)

# Street words of the languages, before and after the street's name.
_STREET = r"(?:rua|r\.|avenida|av\.?|avda\.?|alameda|al\.|travessa|tv\.|praça|praca|largo|estrada|rodovia|calle|c/|paseo|plaza|carrer|camino|carretera)"
_AFTER = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|boulevard|blvd|court|ct|square|terrace|way|place|pl|strasse|straße)"
_PART = r"(?:d[aeo]s?|de la|de los|de las|del|la|las|los|el|e|y)"
_NO = r"(?:\s*,)?\s*(?:(?:n\s?[.º°ª]{1,2}|nº|n°|no\.|num\.|número|numero|núm\.|#)\s*)?"
ADDRESS_BEFORE = re.compile(rf"(?<!\w)(?i:{_STREET})\s+(?:(?i:{_PART})\s+)?(?:(?i:{_PART})\s+)?[^\W\d_][\w'’{LOST}-]*(?:\s+(?:(?i:{_PART})\s+)?[^\W\d_][\w'’{LOST}-]*){{0,3}}?(?i:{_NO})\d{{1,5}}(?!\d|[.,:/h]\d)")
_LOOSE = re.compile(rf"^(?:{_STREET})\s+(?:{_PART}\s+)", re.I)
_STOP = r"(?:in|the|on|of|at|to|from|by|for|people|and|a|is|are|was|over|down|up|along|h|min|am|pm)"
ADDRESS_AFTER = re.compile(rf"(?<![\w.,:/-])\d{{1,5}}(?:\s+(?!{_STOP}\b)[^\W\d_][\w'’-]*){{1,3}}\s+{_AFTER}\b\.?", re.I)

_NUMBER = re.compile(r"(?<![\w./:,@-])(?:\+\s?)?\(?\d(?:[\d]|[  .\-()]{1,2}(?=[\d(])){5,20}\d(?:-?[A-Za-z](?!\w))?(?![\w/:]|[.,-]\d)|(?<![\w./:,@-])[A-Za-z]{1,3}-?\d{6,9}(?:-?[A-Za-z])?(?![\w/:]|[.,-]\d)")
_SURE = re.compile(
    r"(?P<phone>^\+\s?\d[\d .()\- ]{6,}$|^\(\d{2,3}\) ?\d{3,5}[-. ]?\d{4}$)"
    r"|(?P<id_number>^\d{3}\.\d{3}\.\d{3}-\d{2}$|^\d{1,2}\.\d{3}\.\d{3}-[\dXx]$|^\d{8}-?[A-Za-z]$|^[XYZxyz]-?\d{7}-?[A-Za-z]$|^[A-Za-z]{1,2}\d{6,8}$)"
)
_CURRENCY = re.compile(r"[$€£]\s?$")
_GAP, _DIGITS, _LETTERS = re.compile(r"\W+"), re.compile(r"\d"), re.compile(r"[A-Za-z]")
_MOJIBAKE = re.compile(r"[ÃÂâðÐГВвр├┬Γ≡√][^\x00-\x7f]")
_FILLER = re.compile(rf"(?iu)(?<=[\s,;.!?:]){WRITTEN}(?:\.\.\.|[,…])?\s+(?=\S)|^(?:{WRITTEN})(?:\.\.\.|[,…])?\s+")
_WORD = re.compile(rf"[^\W\d_][\w'’{LOST}]*(?:-(?=\w)[\w'’{LOST}]*)*|{LOST}[\w{LOST}]*")
_INVIS = re.compile(f"[{INVISIBLE}]")
_MARKS = re.compile("[\u0300-\u036f]")
_ODD = re.compile(f"[{INVISIBLE}\u0300-\u036f]")
#: Without one of these neither _MOJIBAKE nor _INVIS nor _MARKS has a hit.
_SUSPECT = re.compile(f"[ÃÂâðÐГВвр├┬Γ≡√{INVISIBLE}\u0300-\u036f]")
#: Words of a context: two letters or more, so that a lost letter doesn't make another context.
_CONTEXT = re.compile(r"[^\W_]{2,}")
_PIECE = re.compile(r"[ \n\r\t]+|[^ \n\r\t]+")


def _fold_table() -> dict[str, str]:
    """Base letters of accented Latin letters, by canonical decomposition; combining marks vanish."""
    out = dict.fromkeys(map(chr, range(0x300, 0x370)), "")
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base.isascii():
            out[chr(cp)] = base.lower()
    return out


_TABLE = _fold_table()
_TOKEN = re.compile(rf"[^\W_{LOST}]+|[{LOST}\w]*{LOST}[{LOST}\w]*")
#: The same tokens where no letter is lost and no underscore stands.
_PLAIN_TOKEN = re.compile(r"\w+")
_WIDE = re.compile(r"[^\x00-\x7f]")
#: A word that begins with a letter not known to be small; the look back comes last, so that the search can skip.
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ](?<!\w.)\w")
_LONG_NUMBER = re.compile(r"\d(?:[\s.()\-]{0,2}\d){5}")
_STREET_TOKENS = set("rua r avenida av avda alameda al travessa tv praca largo estrada rodovia calle c paseo plaza carrer camino carretera street st road rd avenue ave lane ln drive boulevard blvd court ct square terrace way place pl strasse".split())
_AT_TOKENS = {"arroba", "at"}


def _fold(s: str) -> str:
    s = s.lower()
    if not s.isascii():
        # few different ones stand in a text, so this takes less than translate()
        for c in _TABLE.keys() & _WIDE.findall(s):
            s = s.replace(c, _TABLE[c])
    return s


#: Words and contexts recur, so their folded forms are kept per worker.
_folded = lru_cache(maxsize=1 << 16)(_fold)


def _tokens(t: str) -> set[str]:
    """The folded tokens of a text."""
    folded = _fold(t)
    return set((_TOKEN if LOST in folded or "_" in folded else _PLAIN_TOKEN).findall(folded))


@lru_cache(maxsize=1 << 16)
def _mended(token: str) -> str:
    """A token with plain garbling undone; garbled tokens recur, so results are kept per worker."""
    return repair(token, {}, -12.0, 2)[0]


def _prepare(text: str, fillers: bool = True) -> tuple[str, list[int] | None]:
    """Text without invisible marks and hesitation sounds and with plain garbling undone, and the
    place of each character in the original (None if nothing changed)."""
    odd = not text.isascii() and _SUSPECT.search(text) and (_MOJIBAKE.search(text) or _INVIS.search(text) or _MARKS.search(text))
    if not odd and not (fillers and _FILLER.search(text)):
        return text, None
    out, at = ([], []) if odd else ([text], range(len(text)))
    for m in _PIECE.finditer(text) if odd else ():
        piece, base = m[0], m.start()
        fixed = piece if not _MOJIBAKE.search(piece) else _mended(piece) if len(piece) < 500 else repair(piece, {}, -12.0, 2)[0]
        if fixed == piece and (piece.isascii() or not _ODD.search(piece)):
            out.append(piece)
            at += range(base, base + len(piece))
        elif fixed != piece:
            n, k = len(piece), len(fixed)
            out.append(fixed)
            at += [base + i * n // k for i in range(k)]
        else:
            for i, c in enumerate(piece):
                if _MARKS.match(c) and out and out[-1]:
                    joined = unicodedata.normalize("NFC", out[-1][-1] + c)
                    if len(joined) == 1:
                        out[-1] = out[-1][:-1] + joined
                        continue
                if not _INVIS.match(c):
                    out.append(c)
                    at.append(base + i)
    clean = "".join(out)
    kept, places, last = [], [], 0
    for m in _FILLER.finditer(clean) if fillers else ():
        kept.append(clean[last : m.start()])
        places += at[last : m.start()]
        last = m.end()
    kept.append(clean[last:])
    places += at[last:]
    return "".join(kept), [*places, len(text)]


def _context(text: str, i: int, j: int) -> tuple[str, str]:
    left = _CONTEXT.findall(text[max(0, i - 40) : i])[-2:]
    right = _CONTEXT.findall(text[j : j + 40])[:2]
    return _folded(" ".join(left)), _folded(" ".join(right))


class Finder:
    """Mentions of one text, given the folded seed words: given names and further names."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.kept: dict[tuple[str, bool], tuple] = {}
        self.masked = {w[:i] + LOST + w[i + 1 :] for w in given for i in range(len(w))}

    def mentions(self, text: str, fillers: bool = True) -> Iterator[tuple]:
        """(kind, state, shape, l2, r2, key, start, end); state: sure, seed (sure and votes), open.

        fillers: hesitation sounds may interrupt what is said (speech). Each search runs only where
        the words of the text leave room for a hit.
        """
        t, at = _prepare(text, fillers)
        tokens = _tokens(t)
        where = (lambda i, j: (i, j)) if at is None else (lambda i, j: (at[i], at[j - 1] + 1 if j else 0))
        taken: list[tuple[int, int]] = []
        free = lambda i, j: all(j <= a or i >= b for a, b in taken)
        if "@" in t or "＠" in t or not tokens.isdisjoint(_AT_TOKENS):
            for m in EMAIL.finditer(t):
                plain = "@" in m[0] or "＠" in m[0]
                spoken_at = re.search(r"\sat\s", m[0], re.I) and not re.search(r"dot|ponto|punto", m[0], re.I)
                if spoken_at or (plain and re.search(r"\s@\s", m[0]) and not re.search(r"@\s*[\w-]+\.[a-z]", m[0], re.I)):
                    continue
                taken.append(m.span())
                yield ("email", "sure", "", "", "", "", *where(*m.span()))
        if not tokens.isdisjoint(_STREET_TOKENS):
            for rx in (ADDRESS_BEFORE, ADDRESS_AFTER):
                for m in rx.finditer(t):
                    if rx is ADDRESS_BEFORE and not (_LOOSE.match(m[0]) or re.search(r"\s[A-ZÀ-ÞŒŠŽ]", m[0]) or m[0].isupper()):
                        continue
                    if free(*m.span()):
                        taken.append(m.span())
                        yield ("address", "sure", "", "", "", "", *where(*m.span()))
        if _LONG_NUMBER.search(t):
            for m in _NUMBER.finditer(t):
                raw = m[0].strip()
                key = _GAP.sub("", raw).upper()
                has_letter = not key.isdigit()
                n = len(_DIGITS.findall(key)) if has_letter else len(key)
                if not 6 <= n <= 15 or not free(*m.span()):
                    continue
                if n < 7 and not has_letter or raw.count("(") != raw.count(")") and raw.count(")"):
                    continue
                before = t[max(0, m.start() - 3) : m.start()]
                if _CURRENCY.search(before):
                    continue
                kind = sure.lastgroup if (sure := _SURE.match(raw)) else None
                taken.append(m.span())
                l2, r2 = _context(t, *m.span())
                shape = _LETTERS.sub("A", _DIGITS.sub("9", raw))
                yield (kind or "", "seed" if kind else "open", shape, l2, r2, key, *where(*m.span()))
        for m in SPOKEN.finditer(t) if len(tokens & _DIGIT_TOKENS) > 2 else ():
            if free(*m.span()):
                taken.append(m.span())
                l2, r2 = _context(t, *m.span())
                key = "".join(str(_digit(w)) for w in re.findall(r"\w+", m[0]))
                yield ("", "open", "spoken", l2, r2, key, *where(*m.span()))
        if LOST in t or _UPPER.search(t) or not self.given.isdisjoint(tokens):
            yield from self._names(t, taken, where)

    def _names(self, t: str, taken: list[tuple[int, int]], where) -> Iterator[tuple]:  # noqa: ANN001
        words = [(m[0], *m.span()) for m in _WORD.finditer(t)]
        flat = t.isupper() or t.islower()
        lost, given = LOST in t, self.given
        k, n = 0, len(words)
        while k < n:
            w, i, _ = words[k]
            folded = _folded(w) if len(w) < 40 else _fold(w)
            title = w[0].isupper() or w[0] == LOST
            is_given = folded in given or (lost and LOST in w and len(w) > 2 and folded in self.masked)
            if not (title or is_given) or (taken and any(a <= i < b for a, b in taken)):
                k += 1
                continue
            # the run of words that can belong to one name
            e, last, family = k + 1, k, False
            while e < n and t[words[e - 1][2] : words[e][1]] in (" ", "  ", ". ") and not any(a <= words[e][1] < b for a, b in taken):
                x, fx = words[e][0], _fold(words[e][0])
                if t[words[e - 1][2] : words[e][1]] == ". " and len(words[e - 1][0]) > 1 and _fold(words[e - 1][0]) not in ("dr", "dra", "sr", "sra", "mr", "mrs", "ms"):
                    break
                if fx in ("de", "da", "do", "dos", "das", "del", "la", "e", "y", "van", "von") and e + 1 < n:
                    e += 1
                    continue
                known = fx in self.family
                if known or (x[:1].isupper() and (not flat or known)):
                    last, family = e, family or known
                    e += 1
                    continue
                break
            i1 = words[last][2]
            l2, r2 = _context(t, i, i1)
            title_given = is_given and w[:1].isupper() and not w.isupper()
            marked = i > 0 and t[i - 1] in "@⁨[~" or (i == 0 and re.match(r"\s?(?::| -)\s", t[i1 : i1 + 3]) is not None)
            garbled_family = family and last > k and not w.isascii() and title
            if is_given and (title_given or family or (marked and title)) or garbled_family:
                yield ("name", "seed", "", l2, r2, folded, *where(i, i1))
            elif is_given or (title and len(w) > 1):
                # open: a word that is also a given name, or capitalised words no seed names
                yield ("name", "open", "given" if is_given else "other", l2, r2, folded, *where(i, i1))
            k = max(last + 1, k + 1)


_VALUE = dict(zip(DIGIT_WORDS, [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 6, 1, 1, 2, 4, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0]))


def _digit(word: str) -> str:
    return str(_VALUE.get(word.lower(), ""))


def seed_words(senders: DataFrame) -> DataFrame:
    """word, part (given or family) from a table with one column ``who`` of people's labels.

    A given name is the first word of three or more different full names, or a label of one word
    that names a speaker; family words are the other words of full names.
    """
    # cut first: else the keys would be computed below the distinct, once for every row
    senders = cut(senders.select("who").distinct())
    key = label_key(F.col("who"))
    full = cut(senders.select(key.alias("k")).distinct()).filter("k is not null and k != '?' and not startswith(k, '#')")
    parts = full.select("k", F.filter(F.split("k", r"[^\p{L}'’-]+"), lambda w: F.length(w) > 0).alias("w")).filter("size(w) > 0")
    first = parts.filter("size(w) > 1").groupBy(F.get("w", F.lit(0)).alias("word")).agg(F.count("*").alias("n")).filter(f"n >= {SUPPORT}").select("word")
    single = parts.filter("size(w) = 1").select(F.get("w", F.lit(0)).alias("word"))
    small_words = ["de", "da", "do", "dos", "das", "del", "la", "los", "las", "e", "y", "van", "von"]
    given = first.unionByName(single).distinct().filter("length(word) > 1 and word rlike '[^0-9]'").withColumn("part", F.lit("given"))
    people = parts.join(given.select("word"), F.get("w", F.lit(0)) == F.col("word"), "left_semi")
    family = people.select(F.explode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).alias("word")).filter(~F.col("word").isin(small_words) & (F.length("word") > 2)).distinct()
    return given.unionByName(family.withColumn("part", F.lit("family")))


def _row_mentions(finder: Finder, src: str, row: int, text: str) -> list[tuple]:
    fillers = src != "parsed"
    if len(text) > KEPT_CHARS:
        return [(src, row, *m) for m in finder.mentions(text, fillers)]
    hits = finder.kept.get((text, fillers))
    if hits is None:
        if len(finder.kept) >= KEPT:
            finder.kept.clear()
        hits = finder.kept[text, fillers] = tuple(finder.mentions(text, fillers))
    return [(src, row, *m) for m in hits]


_COLUMNS = [c.split()[0] for c in MENTION.split(", ")]


def mentions(texts: DataFrame, seeds: DataFrame, most: int = SEED_WORDS) -> DataFrame:
    """All mentions in texts (src, row_id, text). seeds: word, part; up to ``most`` of them are
    broadcast, more are joined."""
    plain = texts.select("src", "row_id", "text").filter("row_id is not null and text is not null and text != ''")
    words = [tuple(r) for r in seeds.select("word", "part").limit(most + 1).collect()]
    if len(words) > most:
        return _joined_mentions(plain, seeds)
    b = texts.sparkSession.sparkContext.broadcast(({w for w, p in words if p == "given"}, {w for w, p in words if p == "family"}))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*b.value)
        for pdf in parts:
            rows = [m for s, r, t in zip(pdf["src"], pdf["row_id"], pdf["text"]) for m in _row_mentions(finder, s, r, t)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return plain.mapInPandas(run, MENTION)


def _joined_mentions(plain: DataFrame, seeds: DataFrame) -> DataFrame:
    """mentions() with each text's own seed words, found by a join on words; a word with a lost letter
    meets the names it may have been."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for s, t in zip(pdf["src"], pdf["text"]):
                clean, _ = _prepare(t, s != "parsed")
                found.append(sorted({_fold(m[0]) for m in _WORD.finditer(clean)} | _tokens(clean)))
            yield pdf.assign(words=found)

    keyed = plain.mapInPandas(split, "src string, row_id long, text string, words array<string>").withColumn("hash", F.xxhash64("text"))
    keyed = cut(keyed)
    given = seeds.filter("part = 'given'").select("word")
    at = F.explode(F.sequence(F.lit(1), F.length("word")))
    masked = given.select("word", at.alias("i")).select("word", F.concat(F.expr("substring(word, 1, i - 1)"), F.lit(LOST), F.expr("substring(word, i + 1)")).alias("seen"))
    table = seeds.select(F.col("word").alias("seen"), "word", "part").unionByName(masked.select("seen", "word", F.lit("given").alias("part"))).distinct()
    used = keyed.select("src", "row_id", "hash", F.explode("words").alias("seen")).distinct().join(table, "seen")
    per = used.groupBy("src", "row_id", "hash").agg(*[F.collect_set(F.when(F.col("part") == p, F.col("word"))).alias(p) for p in ("given", "family")])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none: list = []
        for pdf in parts:
            rows = []
            for s, r, t, g, f in zip(pdf["src"], pdf["row_id"], pdf["text"], pdf["given"], pdf["family"]):
                rows += _row_mentions(Finder(set(none if g is None else g), set(none if f is None else f)), s, r, t)
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return keyed.drop("words").join(per, ["src", "row_id", "hash"], "left").select("src", "row_id", "text", "given", "family").mapInPandas(run, MENTION)


def _patterns(df: DataFrame, extra: list) -> DataFrame:
    """df exploded into its patterns: the word before, the words on either side, and one of each."""
    left, right = F.concat(F.lit("L "), "l2"), F.concat(F.lit("R "), "r2")
    both = F.concat(F.lit("B "), F.element_at(F.split("l2", " "), -1), F.lit(" _ "), F.element_at(F.split("r2", " "), 1))
    near = F.element_at(F.split("l2", " "), -1)
    usable = F.array(F.when(F.length(near) > 2, F.concat(F.lit("N "), near)), F.when(F.length("l2") > 2, left), F.when(F.length("r2") > 2, right), F.when((F.length("l2") > 0) & (F.length("r2") > 0), both))
    return df.select(*extra, F.explode(F.array_compact(usable)).alias("pattern"))


def resolve(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Kinds of the open (family, l2, r2, shape, key) by rounds of pattern and instance scores.

    found: distinct contexts with counts: fam (number or name), kind (of seeds), open, l2, r2,
    shape, key, n.
    """
    labelled = found.filter("not open").select("fam", "kind", "l2", "r2", "n")
    open_ = found.filter("open")
    answer = None
    for _ in range(rounds):
        votes = _patterns(labelled, ["fam", "kind", "n"]).groupBy("fam", "pattern", "kind").agg(F.sum("n").alias("n"))
        # unlabelled capitalised words speak against a name pattern
        against = _patterns(open_.filter("fam = 'name' and shape = 'other'"), ["fam", F.lit("").alias("kind"), "n"]).groupBy("fam", "pattern", "kind").agg(F.sum("n").alias("n"))
        votes = votes.unionByName(against)
        best = votes.groupBy("fam", "pattern").agg(F.sum("n").alias("all"), F.max(F.struct("n", "kind")).alias("top"))
        good = cut(best.filter((F.col("top.kind") != "") & (F.col("top.n") >= SUPPORT) & (F.col("top.n") / F.col("all") >= CONFIDENCE)).select("fam", "pattern", F.col("top.kind").alias("kind"), F.col("top.n").alias("w")))
        hits = _patterns(open_, ["fam", "l2", "r2", "shape", "key", "n"]).join(small(good), ["fam", "pattern"])
        by_kind = hits.groupBy("fam", "l2", "r2", "shape", "key", "kind").agg(F.sum("w").alias("w"), F.max("n").alias("n"), F.count("*").alias("ways"))
        top = by_kind.groupBy("fam", "l2", "r2", "shape", "key").agg(F.max(F.struct("w", "kind", "ways", "n")).alias("v"))
        # an unseen word needs two of its three patterns, known words and numbers one
        sure = top.filter((F.col("shape") != "other") | (F.col("v.ways") >= 2))
        answer = cut(sure.select("fam", "l2", "r2", "shape", "key", F.col("v.kind").alias("kind"), F.col("v.n").alias("n")))
        labelled = found.filter("not open").select("fam", "kind", "l2", "r2", "n").unionByName(answer.select("fam", "kind", "l2", "r2", "n"))
    return answer.drop("n")


def find_personal_data(texts: DataFrame, senders: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """src, row_id, kind, start, end of every piece of personal data in texts (src, row_id, text).

    start and end are code points of the original text. Null ids, null and empty texts hold
    nothing; repeated rows give repeated results; extra columns are ignored.
    """
    seeds = seed_words(senders)
    m = cut(mentions(texts, seeds))
    fam = F.when(F.col("kind") == "name", "name").otherwise("number")
    contexts = (
        m.filter("state != 'sure'")
        .withColumn("key", F.when(F.col("kind") == "name", F.when(F.col("state") == "open", F.col("key")).otherwise("")).otherwise(""))
        .groupBy(fam.alias("fam"), F.when(F.col("state") == "open", F.lit("")).otherwise(F.col("kind")).alias("kind"), (F.col("state") == "open").alias("open"), "l2", "r2", F.when(F.col("state") == "open", F.col("shape")).otherwise("").alias("shape"), "key")
        .agg(F.count("*").alias("n"))
    )
    answer = resolve(cut(contexts), rounds)
    opened = m.filter("state = 'open'").withColumn("fam", fam).withColumnRenamed("key", "instance").withColumn("key", F.when(F.col("kind") == "name", F.col("instance")).otherwise("")).drop("kind")
    opened = cut(opened.join(small(answer), ["fam", "l2", "r2", "shape", "key"], "left").select("src", "row_id", "fam", "instance", "kind", "start", "end"))
    # numbers known by form or context in one row are known in all
    told = m.filter("state = 'seed' and kind != 'name'").select(F.col("key").alias("instance"), "kind").unionByName(opened.filter("fam = 'number' and kind is not null").select("instance", "kind"))
    told = told.groupBy("instance", "kind").agg(F.count("*").alias("n")).groupBy("instance").agg(F.sum("n").alias("all"), F.max(F.struct("n", "kind")).alias("top"))
    told = told.filter(F.col("top.n") / F.col("all") >= CONFIDENCE).select("instance", F.col("top.kind").alias("known"))
    again = opened.filter("fam = 'number' and kind is null").join(told, "instance").select("src", "row_id", F.col("known").alias("kind"), "start", "end")
    named = opened.filter("kind is not null").select("src", "row_id", "kind", "start", "end")
    return m.filter("state != 'open'").select("src", "row_id", "kind", "start", "end").unionByName(named).unionByName(again)


def redact(texts: DataFrame, senders: DataFrame) -> DataFrame:
    """src, row_id, text, redacted: texts that hold personal data, with typed placeholders such as
    [EMAIL]; all other characters stay. Overlapping pieces become one placeholder of the first."""
    hits = find_personal_data(texts, senders).groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("hits"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, hs in zip(text, hits):
            parts, last = [], 0
            for h in hs:
                if h["start"] >= last:
                    parts += [t[last : h["start"]], f"[{h['kind'].upper()}]"]
                last = max(last, h["end"])
            out.append("".join([*parts, t[last:]]))
        return pd.Series(out)

    return texts.join(hits, ["src", "row_id"]).select("src", "row_id", "text", replace("text", "hits").alias("redacted"))


def tables(parsed: DataFrame, utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, senders) of the project's tables."""
    texts = parsed.select(F.lit("parsed").alias("src"), "row_id", F.col("content").alias("text")).unionByName(
        utterances.select(F.lit("utterances").alias("src"), F.col("utt_id").alias("row_id"), "text")
    )
    who = parsed.select(F.col("sender").alias("who")).distinct().unionByName(utterances.select(F.col("speaker").alias("who")).distinct())
    return texts, who.distinct()


def found(parsed: DataFrame, utterances: DataFrame) -> DataFrame:
    texts, who = tables(parsed, utterances)
    return find_personal_data(texts, who).select("src", "row_id", "kind").distinct()


