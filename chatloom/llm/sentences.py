"""Sentence boundaries across languages and scripts (problem 10).

Method: lattices. A text is cut into lines, and lines of a paragraph wrapped to a fixed width are
joined. In spaced scripts every terminator is a node of a lattice whose arcs are sentences. A node
scores by what stands before it (abbreviation, initial, ordinal, inside a quotation) and after it
(opening word, case, closing mark); an arc by what lies in it (brackets it would break, no word at
all). Viterbi search takes the best path. In scripts without spaces a word lattice is decoded by
Viterbi search, over a dictionary gathered from the corpus; each gap (a space in Thai, a mark
behind a quotation in Japanese and Chinese) is then classified by the final particle before it and
the opening word after it.

Scale: one Arrow pass, no shuffle; a document is a task's unit and is read whole, in time linear in
its length. The dictionary counts pieces of the distinct runs of spaceless text; the ``most``
frequent words of it are broadcast.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERM = ".!?…。！？｡．؟۔।॥‼⁇⁈⁉"
_CLOSE = "\"'”’»›)]}）］｝」』】》〉〕“"
_INVIS = "​‌‍‎‏⁠﻿­"
_LINE = re.compile("[^\\r\\n\\u2028\\u2029]*(?:\\r\\n|[\\r\\n\\u2028\\u2029]|$)")
#: List marks, quote marks, headings, speaker labels and stamps with sender at the front of a line.
_STAMP = r"\[?\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4},?\s+\d{1,2}:\d{2}(?::\d{2})?(?:\s?[APap]\.?[Mm]\.?)?\]?(?:\s*[-–—])?\s+[^:\n]{1,60}:\s"
_LABEL = r"[^\W\d_]+(?: [^\W\d_]+)? \d{1,3}\s?[:：]\s?"
_MARK = rf"(?:[>|]\s*|[-*•·–—▪◦]\s+|#{{1,6}}\s+|\(?\d{{1,3}}[.)]\s+|\(?[a-zA-Z]\)\s+|{_STAMP}|{_LABEL})"
PREFIX = re.compile(rf"\s*(?:{_MARK})+")
_MARKED = re.compile(rf"\s*{_MARK}")

# Abbreviations after which a name or number follows.
TITLES = set(
    "dr dra sr sra srta mr mrs ms prof profa eng av avda al r st fl fls art arts pág pag págs p pp n no nº núm num sec vol cap fig figs inc cia co vs cf tel ex "
    "e.g i.e z.b d.h u.a v.a bzw ca nr hr fr frl str abs bd ggf evtl sog approx est dept gen col sgt lt rev hon jr sto sta exmo exma d dª डॉ श्री श्रीमती प्रो د م أ ص".split()
)
# Abbreviations that may also end a sentence.
FINAL_ABBREVIATIONS = set("etc ltda ltd s.a s.l usw p.m a.m u.s e.u d.c a.c jr sr inc corp gmbh".split())
# Words before a name's initials.
BEFORE_INITIAL = set("by por von pela pelo de da do par from to para para_o mit an a com con y e and und".split())
# Words that open sentences.
OPENERS = set(
    "the a an it he she they we you i this that these after before even according nobody who what when where why how did do does is are there in on at if but and so "
    "o os as um uma ele ela eles elas você nós isso este esta depois mesmo segundo ninguém quem que qual quando onde por como ficou custa pediram trouxeram foi assinado no na em se mas "
    "el la los las un una él ella ellos usted nosotros eso después aun según nadie quién qué cuándo dónde cómo se cuesta pidieron trajeron fue firmado en si pero dijo "
    "der die das ein eine er sie es wir ihr ich dieser danach trotzdem laut niemand wer was wann wo warum wie im am auf wenn aber man".split()
)
# Words before a day number that ends in a dot.
BEFORE_ORDINAL = set("am vom zum den der dem im bis ab seit".split())
# Thai words that close a sentence, that open one, and frequent words of the lattice.
THAI_FINAL = "ครับ ครับผม ค่ะ คะ ขา นะ นะคะ นะครับ จ้ะ จ๊ะ จ้า ฮะ สิ ซิ ล่ะ หรอก เถอะ เลย แล้ว ไหม หรือ มั้ย เหรอ".split()
THAI_POLITE = "ครับ ครับผม ค่ะ คะ จ้ะ จ๊ะ จ้า ฮะ".split()
THAI_OPEN = "เรา ผม ฉัน ดิฉัน คุณ เขา เธอ มัน พวกเรา พยาน ใคร อะไร เมื่อไร ทำไม ราคา แต่ และ ดังนั้น จากนั้น อย่างไรก็ตาม วันนี้ พรุ่งนี้ เมื่อวาน คืนนี้ วัน ใน ที่ หลัง ก่อน".split()
THAI_WORDS = "ได้ รับ ได้รับ ไม่ มี เป็น คือ ไป มา อยู่ ให้ ของ กับ จะ ถูก ว่า บอก บอกว่า เห็น รอ ต้อง ตรวจสอบ พร้อม ใช้งาน เสีย หาย อีก ยัง ถึง บาท ชิ้น ใกล้ ตลาด บน ชั้น สอง เช้า บ่าย".split()

_THAI = re.compile(r"[฀-๿]")
_CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
_CJK_CHAR = re.compile(f"[{_CJK}]")
_RUN = r"[\u0E00-\u0E7F]{2,}|[\u4E00-\u9FFF]{2,}|[\u3040-\u309F]{2,}|[\u30A0-\u30FF]{2,}"
#: A word of the corpus dictionary: in so many different runs, after and before so many different characters.
WORD_COUNT, WORD_NEIGHBOURS, WORD_LENGTH = 8, 3, 8
#: Words of the dictionary that are broadcast, the most frequent ones.
DICTIONARY = 100_000
# Words that go on with a sentence behind a quotation.
AFTER_QUOTE = "と って という といった との とか などと 说 问 道 说道 问道 回答 的".split()
#: Widths, in characters, to which paragraphs are usually wrapped; others need this much proof, in nats.
USUAL_WIDTHS, UNUSUAL = (50, 130), 5.0
# Scores of nodes and arcs, as log-odds.
SURE, LIKELY, WEAK, NO_WORD, BROKEN = 4.0, 2.0, 1.0, -3.0, -1e9

_OPEN_TO_CLOSE = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "„": "“", "(": ")", "（": "）", "[": "]", "【": "】"}
_BRACKETS = "(（[【"
_FINAL_END = tuple(THAI_FINAL)
_NEXT = re.compile(rf"[{_INVIS} \t\r\n ]*(.{{0,80}})", re.S)
_CJK_RUN = re.compile(f"[{_CJK}]+")
_GO_ON = "、，,；;：:"
_NEW_QUOTE = re.compile("[「『“（(]")
_MARK_OF_WORD = re.compile(r"[\u0900-\u097f\u0E00-\u0E7F]")
_THAI_RUN = re.compile(rf"[\u0E00-\u0E7F][\u0E00-\u0E7F{_INVIS}]*")
_GAP = re.compile("[  ]+")
_WIDE_GAP = re.compile(r"[  ]+(?=\S)")
_END = re.compile(rf"[{re.escape(_TERM)}]+")
_WORD_BEFORE = re.compile(r"(\S+)\s*$")


def lattice_words(text: str, words: set[str], longest: int) -> list[str]:
    """The path of fewest and longest words through the lattice of dictionary words; characters no
    word covers cost more than a word."""
    n = len(text)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(1e18, 0)] * n
    for i in range(n):
        base = best[i][0]
        if base + 3.0 < best[i + 1][0]:
            best[i + 1] = (base + 3.0, i)
        for j in range(i + 1, min(n, i + longest) + 1):
            if text[i:j] in words and base + 1.0 < best[j][0]:
                best[j] = (base + 1.0, i)
    out, j = [], n
    while j:
        out.append(text[best[j][1] : j])
        j = best[j][1]
    return out[::-1]


def corpus_dictionary(documents: DataFrame, text: str = "text", count: int = WORD_COUNT, neighbours: int = WORD_NEIGHBOURS, longest: int = WORD_LENGTH) -> DataFrame:
    """word, n: pieces of spaceless text that behave like words: they stand in ``count`` different
    runs or more, and behind and before ``neighbours`` different characters (a run's border counts as
    one each time, as any other word may stand beyond it)."""
    runs = documents.filter(F.col(text).rlike(r"[\u0E00-\u0E7F\u3040-\u30FF\u4E00-\u9FFF]")).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)))).alias("run")).distinct()
    runs = runs.withColumn("k", F.length("run"))
    at = F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("k") - F.col("i") + 1))).alias("m")
    p = runs.select("run", "k", at).select("run", "k", "i", size).filter("m > 1")
    word, left, right = F.substring("run", F.col("i"), F.col("m")), F.substring("run", F.col("i") - 1, F.lit(1)), F.substring("run", F.col("i") + F.col("m"), F.lit(1))
    edge = lambda c, cond: F.when(cond, None).otherwise(c)
    p = p.select(word.alias("word"), edge(left, F.col("i") == 1).alias("l"), edge(right, F.col("i") + F.col("m") > F.col("k")).alias("r"))
    kinds = lambda c: F.count_if(F.col(c).isNull()) + F.size(F.collect_set(c))
    return p.groupBy("word").agg(F.count("*").alias("n"), kinds("l").alias("before"), kinds("r").alias("after")).filter((F.col("n") >= count) & (F.col("before") >= neighbours) & (F.col("after") >= neighbours)).select("word", "n")


class _Spans:
    """Quotations and brackets in order: which one is first around a place."""

    def __init__(self, spans: list[tuple[int, int, bool]]) -> None:
        self.spans, self.starts = spans, [a for a, _, _ in spans]
        self.reach = list(accumulate((b for _, b, _ in spans), max))

    def around(self, i: int) -> tuple[int, int, bool] | None:
        """The span that opens first of those that hold place i."""
        if not self.spans:
            return None
        k = bisect_right(self.reach, i)  # spans before k all end at or before i
        while k < len(self.spans) and self.starts[k] < i:
            if self.spans[k][1] > i:
                return self.spans[k]
            k += 1
        return None


class _LastWord:
    """Where the last letter or digit before a place stands."""

    def __init__(self, p: str, begin: int) -> None:
        self.p, self.at, self.last = p, begin, -1

    def before(self, j: int) -> int:
        """For places in order; -1 if there is none."""
        for k in range(j - 1, self.at - 1, -1):
            if self.p[k].isalnum() or _MARK_OF_WORD.match(self.p[k]):
                self.last = k
                break
        self.at = j
        return self.last


class Splitter:
    """words: the corpus's words of scripts without spaces, beside the fixed particles."""

    def __init__(self, words: set[str] | None = None) -> None:
        # particles are words of their own also where the corpus has them as the end of others
        own = {w for w in words or () if not w.endswith(_FINAL_END) or w in THAI_FINAL}
        self.words = set(THAI_FINAL) | set(THAI_OPEN) | set(THAI_WORDS) | set(AFTER_QUOTE) | own
        self.longest = max(map(len, self.words))

    # -- lines and paragraphs

    def paragraphs(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans within which a line break doesn't end a sentence."""
        lines, at = [], 0
        while at < len(text):
            m = _LINE.match(text, at)
            body = m[0].rstrip("\r\n\u2028\u2029")
            lines.append((at, at + len(body), body))
            at = m.end()
        soft = self._soft_breaks(lines)
        start = None
        for k, (a, b, body) in enumerate(lines):
            if start is None:
                start = a
            if k not in soft:
                if text[start:b].strip():
                    yield start, b
                start = None
        if start is not None and text[start:].strip():
            yield start, len(text)

    def _soft_breaks(self, lines: list[tuple[int, int, str]]) -> set[int]:
        """Lines after which a paragraph goes on: each is so full that the next word had no place."""
        plain = [re.sub(rf"[{_INVIS}]", "", re.sub(r"(?<=\S) +", " ", body)).rstrip() for _, _, body in lines]
        pairs = [
            k for k in range(len(lines) - 1)
            if plain[k].strip() and plain[k + 1].strip() and not _MARKED.match(plain[k + 1]) and not re.match(r"\s*#{1,6}\s", plain[k])
        ]
        if not pairs:
            return set()
        spaceless = sum(1 for k in pairs if len(_CJK_CHAR.findall(plain[k])) * 2 > len(plain[k].strip()))
        if spaceless * 2 > len(pairs):
            width = max(len(plain[j]) for k in pairs for j in (k, k + 1))
            full = [k for k in pairs if len(plain[k]) >= width - 1]
            # full lines of sentences: terminators stand within them or behind the last, seldom at their ends
            ends = lambda x: x[-1] in _TERM or x[-1] in _CLOSE
            inside = any(_END.search(plain[k][:-1]) for k in full) or any(ends(plain[k + 1]) for k in pairs if k + 1 not in full)
            return set(pairs) if len(full) == len(pairs) >= 2 and inside and sum(1 for k in full if ends(plain[k])) * 2 < len(full) else set()
        if sum(1 for k in pairs if plain[k].strip().count(" ") >= 3) < len(pairs) * 0.8:
            return set()
        # the width that explains most breaks: a full line goes on, any other must end a sentence
        done = {k for k in pairs if plain[k][-1] in _TERM or plain[k][-1] in _CLOSE}
        need = {k: len(plain[k]) + 1 + len(plain[k + 1].split(None, 1)[0]) for k in pairs}
        open_ = [k for k in pairs if k not in done]
        step: dict[int, list] = {}
        for k in open_:
            for at, sign in ((len(plain[k]), 1), (need[k], -1)):
                step.setdefault(at, []).append((sign, math.log(need[k] - len(plain[k]))))
        widths = sorted({len(plain[j]) for k in pairs for j in (k, k + 1)})
        events, at, fitting, logs = sorted(step.items()), 0, 0, 0.0
        score_at, width_at = 0, None
        for width in widths:
            while at < len(events) and events[at][0] <= width:
                for sign, size in events[at][1]:
                    fitting, logs = fitting + sign, logs + sign * size
                at += 1
            odd = len(open_) - fitting
            score = fitting - 2 * odd
            # how unlikely it is that lines of any length break there; unusual widths need more of it
            proof = fitting * math.log(max(width, 1)) - logs - math.log(len(widths))
            usual = USUAL_WIDTHS[0] <= width <= USUAL_WIDTHS[1]
            if score and score >= score_at and odd * 5 <= len(pairs) and (usual or proof >= UNUSUAL):
                score_at, width_at = score, width
        best = (score_at, {k for k in pairs if width_at is not None and len(plain[k]) <= width_at < need[k]})
        last = [plain[k + 1] for k in best[1] if k + 1 not in best[1]]
        ended = sum(1 for x in last if x[-1] in _TERM or x[-1] in _CLOSE or _THAI.search(x[-4:]))
        return best[1] if ended * 2 > len(last) else set()

    # -- boundaries inside a paragraph

    def _guards(self, p: str) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int]]]:
        """Matched quotations and brackets of a paragraph: (open, close, is_bracket)."""
        spans, stack = [], []
        straight = None
        for m in re.finditer(r"[\"“”«»‹›「」『』《》„()（）\[\]【】]", p):
            ch, i = m[0], m.start()
            if ch == '"':
                if straight is None:
                    if i + 1 < len(p) and not p[i + 1].isspace():
                        straight = i
                else:
                    spans.append((straight, i, False))
                    straight = None
            elif stack and ch == _OPEN_TO_CLOSE[stack[-1][0]]:
                o = stack.pop()
                spans.append((o[1], i, o[0] in _BRACKETS))
            elif ch in _OPEN_TO_CLOSE:
                stack.append((ch, i))
        return spans, stack

    def _nodes(self, p: str, begin: int) -> Iterator[tuple[int, float, int]]:
        """Terminators of p: (where a sentence would end, score, opening bracket that the sentence
        would have to begin with, or -1)."""
        spans, _ = self._guards(p) if re.search(r"[\"“«‹「『《„(（\[【]", p) else ([], None)
        spans.sort()
        opens, closes = {a for a, _, _ in spans}, {b for _, b, _ in spans}
        nearest = _Spans(spans)
        for m in _END.finditer(p, begin):
            i, j = m.start(), m.end()
            span = nearest.around(i)
            while j < len(p) and p[j] in _INVIS:
                j += 1
            closed, bracket = False, -1
            if span:
                # the mark may close the span's content and so the sentence around it
                k = j
                while k < len(p) and (p[k] in _CLOSE or p[k] in _INVIS) and k in closes:
                    k += 1
                if k <= span[1]:
                    continue
                outer = nearest.around(k - 1)
                if outer is not None and outer != span:
                    continue
                bracket = span[0] if span[2] and k < len(p) else -1
                closed, j = not span[2], k
            while j < len(p) and p[j] in _CLOSE and j not in opens:
                j += 1
            while j < len(p) and p[j] in _INVIS:
                j += 1
            if j >= len(p):
                return
            score = self._score(p, m[0], i, j, closed)
            if score is not None:
                yield j, score, bracket

    def boundaries(self, p: str, begin: int) -> list[int]:
        """Ends of sentences inside paragraph p, from ``begin`` (after its marks) on: the best path
        through the lattice of its terminators."""
        nodes = list(self._nodes(p, begin))
        places = [begin, *(j for j, _, _ in nodes)]
        best, come = [0.0], [-1]
        top: list[tuple[float, int]] = [(0.0, 0)]  # the best of all nodes up to each
        seen = _LastWord(p, begin)
        for n, (j, score, bracket) in enumerate([*nodes, (len(p), 0.0, -1)], 1):
            if bracket >= 0:
                # only a sentence that begins with the bracket may end behind it
                lo = bisect_left(places, bracket + 1 - len(p[:bracket]) + len(p[:bracket].rstrip(_INVIS + " \t\r\n")) - 1, 0, n)
                ways = [(best[i], i) for i in range(max(0, lo), n) if places[i] <= bracket and not p[places[i] : bracket].strip(_INVIS + " \t\r\n")]
                value, at = max(ways, default=(BROKEN, 0))
            else:
                far = bisect_right(places, seen.before(j), 0, n) - 1  # the last node with a word between
                value, at = top[far] if far >= 0 else (BROKEN, 0)
                for i in range(far + 1, n):
                    if best[i] + NO_WORD > value:
                        value, at = best[i] + NO_WORD, i
            best.append(value + score)
            come.append(at)
            top.append(max(top[-1], (best[-1], n)))
        cuts, n = [], come[-1]
        while n > 0:
            cuts.append(places[n])
            n = come[n]
        cuts.reverse()
        if _THAI.search(p):
            cuts += self._thai_gaps(p, begin, set(cuts))
            cuts.sort()
        return cuts

    def _score(self, p: str, mark: str, i: int, j: int, quoted: bool) -> float | None:
        """Log-odds that a sentence ends at j, behind the mark at i; None where it can't."""
        nxt = _NEXT.match(p, j)[1]
        if not nxt:
            return None
        spaced = p[j].isspace() or p[j] in "  　"
        wide = mark[0] in "。！？｡．" or (not spaced and _CJK_CHAR.match(p[j]) is not None)
        if wide or (_CJK_CHAR.match(nxt) and mark[-1] not in "…."):
            if mark.strip("…") == "" or mark == "." and not spaced:
                return None
            if quoted:  # the opening word tells whether the sentence goes on
                head = _CJK_RUN.match(nxt)
                goes_on = head is None or lattice_words(head[0], self.words, self.longest)[0] in AFTER_QUOTE or nxt[0] in _GO_ON
                return None if goes_on or not _NEW_QUOTE.match(nxt) else WEAK
            ends = nxt[0] not in "、，,；;：:と" or mark[0] in "！？" and nxt[0] not in "、，,：:"
            return SURE if ends else None
        if mark.strip("…") == "" and _CJK_CHAR.search(p[max(0, i - 1) : i]):
            return None
        if not spaced:
            return None
        first = nxt.lstrip("\"'“‘«‹„(¿¡[*_—–- ")
        c = first[:1]
        if not c or c.islower():
            return None
        if c.isdigit() and mark == "." and (self._abbreviation(p, i) == "title" or re.search(r"(?<!\w)[^\W\d_]$", p[max(0, i - 2) : i])):
            return None
        cased = c.isupper()
        if (quoted and not cased) or nxt[0] in ",;:)":
            return None
        if mark != ".":
            return SURE
        kind = self._abbreviation(p, i)
        word = re.match(r"[^\W\d_]+", first)
        opener = word is not None and word[0].lower() in OPENERS
        if kind in ("title", "ordinal"):
            return None
        if kind == "initial":
            return WEAK if opener else None
        if kind == "final":
            return LIKELY if cased or not c.isalpha() else None
        return SURE

    def _abbreviation(self, p: str, i: int) -> str:
        """What a full stop at i belongs to: title, final, initial, ordinal or nothing."""
        m = _WORD_BEFORE.search(p[max(0, i - 40) : i])
        if not m:
            return ""
        w = m[1].lstrip("\"'“‘«‹„(¿¡[*_" + _INVIS).rstrip(_INVIS)
        low = w.lower()
        before = _WORD_BEFORE.search(p[max(0, i - 80) : max(0, i - len(m[0]))])
        prev = (before[1] if before else "").strip("\"'“”‘«»„(¿¡[*_,;:" + _INVIS)
        if len(w) == 1 and w.isalpha() and w.isupper():
            lead = prev.rstrip(".")
            if not prev or prev.endswith(":") or (len(lead) == 1 and lead.isupper()) or lead.lower() in BEFORE_INITIAL or lead.lower() in TITLES:
                return "initial"
            if lead.islower() and len(lead) >= 3:
                return ""
            return "initial" if lead[:1].isupper() else ""
        if len(w) == 1 and w.islower():
            return "title"
        if low in TITLES:
            return "title" if low not in FINAL_ABBREVIATIONS else "final"
        if low in FINAL_ABBREVIATIONS:
            return "final"
        if w.isdigit() and len(w) <= 2 and prev.lower() in BEFORE_ORDINAL:
            return "ordinal"
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", w):
            return "final"
        return ""

    def _opens(self, word: str) -> bool:
        """An opening word, or a corpus word made of one and another word."""
        return word in THAI_OPEN or any(word.startswith(o) and word[len(o) :] in self.words for o in THAI_OPEN)

    def _thai_gaps(self, p: str, begin: int, known: set[int]) -> list[int]:
        """Spaces between Thai runs at which a sentence ends: behind a polite particle, or behind a
        final word where an opening word follows. Each run is decoded once, whole."""
        cuts = []
        before: tuple[int, str] | None = None  # end of the last run and its last word
        for m in _THAI_RUN.finditer(p):
            words = lattice_words(re.sub(f"[{_INVIS}]", "", m[0]), self.words, self.longest)
            if before is not None and before[0] >= begin and before[0] not in known and _GAP.fullmatch(p, before[0], m.start()):
                if before[1] in THAI_POLITE or (before[1] in THAI_FINAL and words and self._opens(words[0])):
                    cuts.append(before[0])
            elif before is not None and before[1] in THAI_POLITE and before[0] >= begin and before[0] not in known and _WIDE_GAP.match(p, before[0]):
                cuts.append(before[0])
            before = (m.end(), words[-1] if words else "")
        if before is not None and before[1] in THAI_POLITE and before[0] >= begin and before[0] not in known and _WIDE_GAP.match(p, before[0]):
            cuts.append(before[0])
        return cuts

    def sentences(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every sentence, without outer white space."""
        for a, b in self.paragraphs(text):
            p = text[a:b]
            mark = PREFIX.match(p)
            begin = mark.end() if mark else 0
            last = 0
            for c in [*self.boundaries(p, begin), len(p)]:
                piece = p[last:c]
                s = len(piece) - len(piece.lstrip())
                e = len(piece.rstrip())
                if e > s:
                    yield a + last + s, a + last + e
                last = c


def split_sentences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dictionary: DataFrame | None = None, most: int = DICTIONARY) -> DataFrame:
    """doc_id, sentence_no (from 1), start_char, end_char (code points, end exclusive), sentence.

    dictionary: word, n of scripts without spaces; corpus_dictionary of the documents if None; the
    ``most`` frequent are used. Null ids and null, empty or blank texts have no sentences. Repeated
    rows give repeated results; extra columns are ignored.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null and text != ''")
    table = corpus_dictionary(docs) if dictionary is None else dictionary
    words = {r["word"] for r in table.orderBy(F.desc("n"), "word").limit(most).select("word").collect()}
    sent = documents.sparkSession.sparkContext.broadcast(words)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(sent.value)
        for pdf in parts:
            rows = [(d, n, a, b, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["text"]) for n, (a, b) in enumerate(splitter.sentences(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_no", "start_char", "end_char", "sentence"])

    return docs.mapInPandas(run, "doc_id long, sentence_no long, start_char long, end_char long, sentence string")


def found(documents: DataFrame) -> DataFrame:
    return split_sentences(documents).select("doc_id", "start_char", "end_char")
