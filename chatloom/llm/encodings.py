"""Garbled text from wrong character encoding (problem 5).

Method: noisy-channel decoding. Characters of a token are turned back into the bytes they stood
for under a wrong code page; runs of them that form UTF-8 are arcs of a lattice beside the arcs
that keep each character, and a lost byte is a wildcard that keeps what is known of its sequence:
its lead byte. Viterbi search picks the path of highest probability under corpus character
frequencies; the candidates it gives are then weighed by corpus word frequencies and by how often
exports of the same stated encoding are damaged. The most frequent word that agrees in every byte
that is left fills the wildcards.

Scale: only tokens with characters outside ASCII are looked at, each distinct token once. Word
frequencies stay distributed and are joined; only counts by character, which Unicode bounds, reach
the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import cut, small

LOST = "�"
_CORE = re.compile(r"^[^\w\ufffd\ue0c2-\ue0f4]+|[^\w\ufffd\ue0c2-\ue0f4]+$|^_+|_+$")
_HAS_WILD = re.compile("[\ufffd\ue0c2-\ue0f4]")
#: Code pages that UTF-8 bytes are mistaken for, most usual first.
CHANNELS = ("cp1252", "cp1251", "cp437", "cp850", "mac_roman")
#: Cost, in nats, of one sequence having been decoded wrongly.
NOISE = 2.0
#: Gain over keeping a token that a repair needs without any known word.
GAIN = 6.0
# Punctuation that stands right behind a letter in ordinary text.
AFTER_LETTERS = "…‘’“”–—»ª°º"
_PUNCT = r"[\p{P}\p{S}\p{Z}\p{C}]+"


#: A lost character of which the lead byte is known is written as LEAD + byte inside this module.
LEAD = 0xE000
_WILD = f"{LOST}{chr(LEAD + 0xC2)}-{chr(LEAD + 0xF4)}"
_TO_LOST = {LEAD + b: LOST for b in range(0xC2, 0xF5)}


@lru_cache(maxsize=None)
def byte_of(channel: str) -> dict[str, int]:
    """Character -> byte under a code page; bytes it leaves undefined stand for themselves (C1)."""
    out = {chr(b): b for b in range(0x80, 0xA0)} if channel == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(channel)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _sequence(bs: list[int]) -> str | None:
    try:
        s = bytes(bs).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) == 1 else None


def _space_leads() -> str:
    """Characters whose sequence is à or a no-break space if the space behind them was a byte (0xA0)."""
    tables = [t for t in map(byte_of, CHANNELS) if t.get("\xa0") == 0xA0]
    return "".join(sorted({c for t in tables for c, b in t.items() if 0xC2 <= b <= 0xDF and _sequence([b, 0xA0]) in ("à", "\xa0")}))


#: A lone lead between ASCII words in lower case: the byte behind it is now an ordinary space, or gone.
LONE_LEAD = rf"(?:^|[a-z0-9][,.:;!?)]?[ \n\r\t]+)[{_space_leads()}](?=$|[ \n\r\t]+(?:$|[a-z0-9]))"


def headless(token: str) -> str | None:
    """token with a wildcard for each two-byte lead inside a word in lower case whose second byte is gone
    (followed by a letter in lower case or the end); None if there is none."""
    out = list(token)
    for i in range(1, len(token)):
        ch, before, after = token[i], token[i - 1], token[i + 1 : i + 2]
        if ("a" <= before <= "z") and (not after or "a" <= after <= "z") and not ch.islower() and 0xC2 <= byte_of("cp1252").get(ch, 0) <= 0xDF:
            out[i] = chr(LEAD + byte_of("cp1252")[ch])
    return None if out == list(token) else "".join(out)


def viterbi(token: str, channel: str, logp: dict[str, float], floor: float, noise: float = NOISE) -> tuple[str, float, int]:
    """(text, gain over keeping every character, repaired sequences) of the best path; a negative
    noise makes every sequence that can be repaired worth it."""
    table, n = byte_of(channel), len(token)
    score = [0.0] + [-math.inf] * n
    back: list[tuple[int, str, int]] = [(0, "", 0)] * (n + 1)
    keep = 0.0

    def arc(i: int, j: int, value: float, emit: str, fixed: int) -> None:
        if value > score[j]:
            score[j], back[j] = value, (i, emit, fixed)

    for i, ch in enumerate(token):
        here = 0.0 if ch.isascii() else logp.get(ch, floor)
        keep += here
        arc(i, i + 1, score[i] + here, ch, 0)
        lead = table.get(ch, 0)
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        lost = score[i] + floor / 2 - noise  # bytes are gone: any character with this lead
        if size and i + size <= n:
            rest = token[i + 1 : i + size]
            tail = [table.get(x, 0) for x in rest]
            if all(0x80 <= b <= 0xBF for b in tail) and (new := _sequence([lead, *tail])):
                arc(i, i + size, score[i] + logp.get(new, floor) - noise, new, 1)
            elif LOST in rest and all(x == LOST or 0x80 <= b <= 0xBF for x, b in zip(rest, tail)):
                arc(i, i + size, lost, chr(LEAD + lead), 1)
        if size >= 3:  # the last bytes are gone without a trace
            have = 1
            while have < size and i + have < n and 0x80 <= table.get(token[i + have], 0) <= 0xBF:
                have += 1
            if 2 <= have < size and not (have == 2 and token[i + 1] in AFTER_LETTERS):
                arc(i, i + have, lost, chr(LEAD + lead), 1)
    parts, fixed, j = [], 0, n
    while j:
        i, emit, k = back[j]
        parts.append(emit)
        fixed += k
        j = i
    return "".join(reversed(parts)), score[n] - keep, fixed


def wildcard_pattern(text: str) -> str:
    """A pattern of the words that text may have been: each wildcard is any character of its lead
    byte, or any run beyond ASCII where that is lost too."""
    out = []
    for ch in text:
        b = ord(ch) - LEAD
        if ch == LOST:
            out.append("[^\\x00-\\x7F]+")
        elif 0xC2 <= b <= 0xF4:
            size, low = (6, b & 0x1F) if b <= 0xDF else (12, b & 0x0F) if b <= 0xEF else (18, b & 0x07)
            first = max(low << size, 0x80 if b <= 0xDF else 0x800 if b <= 0xEF else 0x10000)
            out.append(f"[\\x{{{first:x}}}-\\x{{{min((low << size) + (1 << size) - 1, 0x10FFFF):x}}}]")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def repair(token: str, logp: dict[str, float], floor: float, depth: int = 3) -> tuple[str, float, int]:
    """best_path with every wildcard as U+FFFD."""
    text, gain, n = best_path(token, logp, floor, depth)
    return text.translate(_TO_LOST), gain, n


def best_path(token: str, logp: dict[str, float], floor: float, depth: int = 3) -> tuple[str, float, int]:
    """(text, gain, sequences) of the best repair over all code pages.

    Text garbled more than once needs a step that only pays with the next one, so steps are taken
    both where they pay and wherever they are possible, and the end results are compared.
    """
    cost = lambda t: sum(0.0 if c.isascii() else floor / 2 if c == LOST or 0xC2 <= ord(c) - LEAD <= 0xF4 else logp.get(c, floor) for c in t)
    base, best = cost(token), (token, 0.0, 0)
    seen, front = {token}, [(token, 0)]
    for _ in range(depth):
        after = []
        for text, fixed in front:
            for channel in CHANNELS:
                for noise in (NOISE, -1e3):
                    got, _, n = viterbi(text, channel, logp, floor, noise)
                    if not n or got in seen:
                        continue
                    seen.add(got)
                    gain = cost(got) - base - NOISE * (fixed + n)
                    after.append((got, fixed + n))
                    if gain > best[1]:
                        best = (got, gain, fixed + n)
        front = after
        if not front:
            break
    return best


def _tokens(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("row_id", "told", F.explode(F.array_distinct(F.filter(F.split(text, r"[ \n\r\t]+"), lambda t: t.rlike(r"[^\x00-\x7F]")))).alias("token"))


def odd_tokens(rows: DataFrame, text: str = "content") -> DataFrame:
    """token, told, n: in how many rows each token with a character outside ASCII stands, by the
    encoding that the rows' exports state."""
    return _tokens(rows, text).groupBy("token", "told").agg(F.count("*").alias("n"))


def token_repairs(odd: DataFrame) -> DataFrame:
    """damaged tokens: token, fixed (null where nothing better is known), lost (bytes are gone)."""
    spark = odd.sparkSession
    odd = cut(odd)
    chars = odd.select("n", F.explode(F.split("token", "")).alias("c")).filter(F.col("c").rlike(r"[^\x00-\x7F]")).groupBy("c").agg(F.sum("n").alias("n"))
    counts = {r["c"]: r["n"] for r in chars.collect()}  # one row per Unicode character at most
    total = sum(counts.values()) + 1
    logp = spark.sparkContext.broadcast({c: math.log(n / total) for c, n in counts.items()})
    floor = math.log(0.5 / total)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [best_path(t, logp.value, floor) for t in pdf["token"]]
            got = [(h, 0.0, 1) if not g[2] and (h := headless(t)) else g for t, g in zip(pdf["token"], got)]
            core = [_CORE.sub("", g[0]).lower() for g in got]
            wild = [wildcard_pattern(c) if _HAS_WILD.search(c) else None for c in core]
            yield pd.DataFrame({"token": pdf["token"], "n": pdf["n"], "fixed": [g[0] for g in got], "gain": [g[1] for g in got], "seqs": [g[2] for g in got], "like": wild})

    whole = odd.groupBy("token").agg(F.sum("n").alias("n"))
    # a long list of tokens mustn't end up in the few partitions its bytes ask for
    spread = whole.repartition(spark.sparkContext.defaultParallelism, "token")
    tried = cut(spread.mapInPandas(run, "token string, n long, fixed string, gain double, seqs long, like string"))
    word = lambda c: F.lower(F.regexp_replace(c, rf"^{_PUNCT}|{_PUNCT}$", ""))
    mask = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]+", LOST)
    wild = lambda c: F.col(c).rlike(f"[{_WILD}]")

    clean = tried.filter((F.col("seqs") == 0) & ~wild("token"))
    vocab = clean.groupBy(word(F.col("token")).alias("word")).agg(F.sum("n").alias("freq"), F.max_by(F.regexp_replace("token", rf"^{_PUNCT}|{_PUNCT}$", ""), "n").alias("as_written"))
    known = tried.filter(f"seqs > 0 or instr(token, '{LOST}') > 0").withColumn("word", word(F.col("fixed"))).join(vocab.select("word", "freq"), "word", "left")

    # log-odds that an export of a stated encoding is damaged, from the repairs that need no prior
    sure = known.filter((F.col("seqs") > 0) & ((F.coalesce("freq", F.lit(0)) > 0) | (F.col("seqs") > 1))).select("token").withColumn("bad", F.lit(1))
    seen = odd.join(sure, "token", "left")
    share = lambda n, bad: (F.sum(F.when(F.col("bad") == 1, F.col(n)).otherwise(0)) + bad) / (F.sum(n) + 1.0)
    every = seen.agg(share("n", 0.5).alias("all"))
    by_told = seen.groupBy("told").agg(share("n", 0.5).alias("here")).join(F.broadcast(every)).select("told", F.log(F.col("here") / F.col("all")).alias("prior"))  # every: one row
    prior = odd.join(F.broadcast(by_told), odd["told"].eqNullSafe(by_told["told"])).groupBy("token").agg((F.sum(F.col("prior") * F.col("n")) / F.sum("n")).alias("prior"))
    known = known.join(prior, "token", "left")

    shifted = known.filter((F.col("seqs") > 0) & ~wild("fixed"))
    shifted = shifted.filter((F.coalesce("freq", F.lit(0)) > 0) | (F.col("gain") + F.coalesce("prior", F.lit(0.0)) >= GAIN) | (F.col("seqs") > 1))
    # wildcards: the most frequent word that agrees in every byte that is left
    gone = known.filter(wild("fixed")).withColumn("core", F.regexp_replace(F.col("fixed"), rf"^[^\p{{L}}\p{{N}}{_WILD}]+|[^\p{{L}}\p{{N}}{_WILD}]+$", ""))
    gone = gone.withColumn("key", mask(F.lower(F.col("core"))))
    words = vocab.withColumnRenamed("word", "guess").withColumn("key", mask(F.col("guess"))).withColumnRenamed("freq", "f").filter(F.col("key") != LOST)
    fits = gone.select("token", "key", "like").join(words, "key").filter(F.rlike("guess", F.col("like")))
    fits = fits.groupBy("token").agg(F.max_by("guess", F.struct("f", "guess")).alias("guess"), F.max_by("as_written", F.struct("f", "guess")).alias("as_written"))
    gone = gone.join(fits, "token", "left")
    upper = (F.col("core") == F.upper("core")) & F.col("core").rlike(r"\p{L}")
    first = F.substring("core", 1, 1)
    is_wild = first.rlike(f"[{_WILD}]")
    guess = F.when(upper, F.upper("guess")).when((first != F.lower(first)) & ~is_wild, F.initcap("guess")).when(is_wild, F.col("as_written")).otherwise(F.col("guess"))
    at = F.instr(F.col("fixed"), F.col("core"))
    filled = F.concat(F.substring("fixed", F.lit(1), at - 1), guess, F.substring(F.col("fixed"), at + F.length("core"), F.length("fixed")))
    return shifted.select("token", "fixed", F.lit(False).alias("lost")).unionByName(gone.select("token", filled.alias("fixed"), F.lit(True).alias("lost")))


def restore(rows: DataFrame, text: str = "content", archives: DataFrame | None = None) -> DataFrame:
    """row_id, restored, complete: rows whose ``text`` was decoded wrongly, with the text as far as
    it can be recovered; complete is false where lost bytes stay unknown.

    archives: source_zip, encoding; what rows' exports state is weighed by how often such exports
    are damaged. row_id must identify a row; of repeated rows of one id the smallest text counts.
    Null ids and null texts are left out, empty texts are never damaged. Extra columns are ignored.
    """
    told = F.lit(None).cast("string").alias("told")
    if archives is not None:
        stated = archives.filter("source_zip is not null").groupBy("source_zip").agg(F.min("encoding").alias("told"))
        rows = rows.select("row_id", "source_zip", text).join(small(stated), "source_zip", "left")
        told = F.lower("told").alias("told")
    rows = rows.select("row_id", told, F.col(text).alias("text")).filter("row_id is not null and text is not null")
    suspects = rows.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    fixes = cut(token_repairs(odd_tokens(suspects, "text")))
    tokens = _tokens(suspects, "text").join(small(fixes), "token").groupBy("row_id").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", F.coalesce("fixed", "token"))))).alias("fix"), F.bool_and(F.col("fixed").isNotNull()).alias("complete")
    )
    lone = suspects.filter(F.col("text").rlike(LONE_LEAD)).select("row_id", F.lit(True).alias("lone")).dropDuplicates(["row_id"])
    hits = tokens.join(lone, "row_id", "full").withColumn("complete", F.coalesce("complete", F.lit(True)) & F.col("lone").isNull())
    parts = F.split("text", r"(?<=[ \n\r\t])|(?=[ \n\r\t])")
    out = suspects.groupBy("row_id").agg(F.min("text").alias("text")).join(hits, "row_id")
    return out.select("row_id", F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at("fix", t), t)), "").alias("restored"), "complete")


def found(parsed: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    return restore(parsed, archives=archives).select("row_id")
