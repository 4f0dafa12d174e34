"""Speech transcripts into clean speaker turns (problem 1).

Method: a semi-Markov conditional model. A turn is a segment of consecutive utterances with one
speaker, and the best segmentation maximises the sum of scores of whole segments: the label
evidence of its utterances, the pauses inside it, how many of an utterance's words the turn has
used before, a prior of the turn's length and a cost per turn; neighbouring segments differ in
speaker. ``SegmentModel.fit`` learns the weights from labelled recordings with labels hidden. An
identified label outweighs all other evidence together (``decisive``), as the stated rule wants:
with ``unidentified="own"`` utterances without label are evidence for the recording's unknown
speaker and the optimum is the longest runs; with ``"infer"`` they may take the speaker on either
side that pauses, words and length suggest. Stamps, labels, hesitation sounds and annotations are
removed while a turn's text is rebuilt.

Scale: cleaning is one projection. Segmentation runs per (recording, time slice); slices are
joined by comparing border labels in a window over one row per slice, so no recording, however
long, is gathered in one task. Identified utterances part the model's evidence, so to infer
speakers slices end at them and the result doesn't depend on the slices' length.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE, fold_accents, is_ascii
from chatloom.operators.ordering import last_before
from chatloom.session import BROADCAST_ROWS, apart, cut, small

#: Seconds of a slice.
SLICE_S = 600.0
#: Speech gives more letters a second than this; whole numbers with fewer letters a unit are milliseconds.
SLOWEST = 0.5
#: Length, in utterances, from which on a turn's length and the words it remembers no longer grow.
AGE = 8
UNKNOWN = "?"

# Words that stand for "nobody knows who" as a label.
UNKNOWN_LABELS = ["", "?", "unknown", "desconhecido", "desconhecida", "desconocido", "desconocida", "n/a", "none", "null", "unbekannt", "inconnu"]
# Words that number a speaker.
GENERIC = r"(?:speaker|spk|spkr|falante|locutor|locutora|hablante|orador|sprecher|s)"
# Hesitation sounds, in folded letters, and as written.
HESITATIONS = r"(?:h+u*m+|m{2,}h*|a+h+n+|a+h+|e{2,}h*|e+h+m*|e+r+m+|u+h+m*|mhm|ejem)"
WRITTEN = r"(?:h+u*m+|m{2,}h*|[aãâ]+h+n+|a+h+|h+ã+n*|[eéê]{2,}h*|[eé]+h+m*|e+r+m+|u+h+m*|mhm|ejem)"
# Sounds that are also words; they count as sounds where nothing else is said.
AMBIGUOUS = r"(?:u+m+|h+a+n*|a+n+|e+r+|e|a+|o+h*|este)"

_STAMP = r"(?:[\[(<]\s*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\s*[\])>]|\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})\s*[-–—:])"
_ANNOTATION = r"\[[^\[\]]+\]|<[^<>@]+>|\*[^*\n]+\*|\(\s*[\p{L}][\p{L} ,.'’-]*\)|[♪♫♬♩]+"
_NAME = r"~?\s*(?:(?:[Dd][Rr][Aa]?|[Ss][Rr][Aa]?|[Mm][Rr][Ss]?)\.\s*)?\p{L}[\p{L}'’.-]*(?: \p{L}[\p{L}'’.-]*){0,4}(?: ?\([\p{L} ]{1,30}\))?|" + rf"(?i:{GENERIC})[ _-]?\d{{1,4}}"


def label_key(c: Column) -> Column:
    """One key for all spellings of a label; UNKNOWN for labels that name nobody; null stays null."""
    t = F.lower(fold_accents(F.regexp_replace(c, f"[{INVISIBLE}]", "")))
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"^[\s~\[<(]+|[\s:;,\])>-]+$", "")
    t = F.regexp_replace(t, r"^(?:dr|dra|sr|sra|mr|mrs|ms|prof)\.\s*", "")
    t = F.trim(F.regexp_replace(t, r"[\s_]+", " "))
    number = F.regexp_extract(t, rf"^{GENERIC}[ _-]?0*(\d{{1,4}})$", 1)
    return (
        F.when(c.isNull(), None)
        .when(t.isin(UNKNOWN_LABELS), UNKNOWN)
        .when(number != "", F.concat(F.lit("#"), number))
        .otherwise(t)
    )


def _stamped(utts: DataFrame) -> DataFrame:
    """utts plus line (text without invisible marks), lead (a stamp at its front with its spaces) and
    stamp_s (its seconds)."""
    text = F.coalesce("text", F.lit(""))
    u = utts.withColumn("line", F.when(is_ascii(text), text).otherwise(F.regexp_replace(text, f"[{INVISIBLE}]", "")))
    u = u.withColumn("lead", F.regexp_extract("line", rf"^\s*{_STAMP}\s*", 0))
    parts = F.split(F.regexp_replace("lead", r"[^\d:.,]|[-–—:\s]+$", ""), ":")
    secs = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + F.coalesce(F.regexp_replace(x, ",", ".").try_cast("double"), F.lit(0.0)))
    return u.withColumn("stamp_s", F.when(F.col("lead") != "", secs))


def time_units(utts: DataFrame) -> DataFrame:
    """recording_id, unit: 1000 for recordings whose times are milliseconds, else 1.

    Stamps in the text decide; without any, times that are whole numbers throughout and so long that
    less than SLOWEST letters a unit were spoken are milliseconds.
    """
    u = _stamped(utts.select("recording_id", "start_time", "end_time", "text"))
    whole = lambda c: F.coalesce(F.col(c) == F.floor(c), F.lit(True))
    took = F.when(F.col("end_time") > F.col("start_time"), F.col("end_time") - F.col("start_time"))
    per = u.groupBy("recording_id").agg(
        F.max(F.when(F.col("start_time").isNotNull() & (F.col("stamp_s") > 1), F.col("start_time") / F.col("stamp_s"))).alias("ratio"),
        F.bool_and(whole("start_time") & whole("end_time")).alias("whole"),
        (F.sum(F.when(took.isNotNull(), F.length("line"))) / F.sum(took)).alias("rate"),
    )
    ms = F.when(F.col("ratio").isNotNull(), F.col("ratio") > 100).otherwise(F.coalesce(F.col("whole") & (F.col("rate") < SLOWEST), F.lit(False)))
    return per.filter(ms).select("recording_id", F.lit(1000.0).alias("unit"))


def clean_utterances(utts: DataFrame, with_text: bool = True) -> DataFrame:
    """utt_id, recording_id, label, t (place in seconds), end, words, spoken (there is a spoken word)
    and, with_text, said (readable text); repeats count once as the smallest utt_id."""
    utts = utts.select("utt_id", "recording_id", "speaker", "start_time", "end_time", "text").filter("recording_id is not null and utt_id is not null")
    u = _stamped(utts)
    u = u.withColumn("rest", F.when(F.col("lead") == "", F.col("line")).otherwise(F.substring("line", F.length("lead") + 1, F.length("line"))))

    # a label at the front counts if it numbers a speaker or is the label of some utterance
    may = F.col("rest").contains(":") | F.col("rest").contains("[") | F.col("rest").rlike(" [-–—] ")
    front = F.when(may, F.regexp_extract("rest", rf"^\s*(?:\[((?:{_NAME}))\]\s*|((?:{_NAME}))\s*(?::| [-–—])\s+)", 0))
    u = u.withColumn("front", F.nullif(front, F.lit("")))
    bare = F.regexp_replace(F.trim("front"), r"^\[|\]$|\s*(?::|[-–—])$", "")
    u = u.withColumn("front_key", F.when(F.col("front").isNotNull(), label_key(bare)))
    # few spellings make many rows: each is worked out once
    labels = cut(utts.select("speaker").filter("speaker is not null").distinct().withColumn("key", label_key(F.col("speaker"))))
    known = labels.select("key").distinct().filter(F.col("key").isNotNull() & (F.col("key") != UNKNOWN)).select(F.col("key").alias("join_key"), F.lit(True).alias("is_label"))
    # utterances without a front label must not meet in one task
    u = u.withColumn("join_key", F.coalesce("front_key", F.concat(F.lit("\0"), F.col("utt_id").cast("string")))).join(small(cut(known)), "join_key", "left")
    labelled = F.col("front_key").isNotNull() & (F.col("front_key").startswith("#") | F.coalesce("is_label", F.lit(False)))
    if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        u = u.join(F.broadcast(labels.withColumnRenamed("key", "own")), "speaker", "left")
    else:  # a join that isn't a broadcast would gather the rows of a common label
        u = u.withColumn("own", label_key(F.col("speaker")))
    u = u.withColumn("labelled", labelled)
    u = u.withColumn("label", F.coalesce("own", F.when(F.col("labelled"), F.col("front_key")), F.lit(UNKNOWN)))
    u = u.withColumn("body", F.when(F.col("labelled"), F.substring("rest", F.length("front") + 1, F.length("rest"))).otherwise(F.col("rest")))
    u = u.withColumn("body", F.when(F.col("body").rlike(r"[\[<*(♪♫♬♩]"), F.regexp_replace("body", _ANNOTATION, " ")).otherwise(F.col("body")))

    u = apart(u)
    u = u.withColumn("low", F.lower("body")).withColumn("low", fold_accents(F.col("low"))).withColumn("low", F.regexp_replace("low", r"[^\p{L}\p{M}\p{N}]+", " "))
    sound = rf"(?:^| )(?:{HESITATIONS} )*{HESITATIONS}(?= |$)"
    u = u.withColumn("words", F.trim(F.regexp_replace("low", sound, " ")))
    said = []
    if with_text:
        t = F.regexp_replace("body", rf"(?iu)(?<=^|[\s,;.!?]){WRITTEN}(?=$|[\s,;.!?…])(?:[,…]|\.{{3}})?", " ")
        u = u.withColumn("said", F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([,.;!?])", "$1"), r"\s+", " ")))
        said = [F.min_by("said", "utt_id").alias("said")]
    u = u.join(small(cut(time_units(utts))), "recording_id", "left")
    unit = F.coalesce("unit", F.lit(1.0))
    start, end = F.col("start_time") / unit, F.col("end_time") / unit
    u = u.withColumn("t", F.coalesce(start, F.col("stamp_s"), end, F.lit(1e12))).withColumn("end", F.coalesce(end, F.col("t")))
    got = u.groupBy("recording_id", F.round("t", 2).alias("t"), "label", "words").agg(F.min("utt_id").alias("utt_id"), F.max("end").alias("end"), *said)
    # sounds that are words in other places, such as um, are none where nothing else is said. A
    # filter here would be pushed below the patterns and run them all a second time.
    return got.withColumn("spoken", (F.col("words") != "") & ~F.col("words").rlike(rf"^{AMBIGUOUS}(?: {AMBIGUOUS})*$"))


class SegmentModel:
    """Scores of whole turns.

    A segment of utterances i..j and speaker y scores the sum of ``label`` for each utterance
    labelled y, minus ``turn``, minus ``pause`` for each silence inside it (0 for none up to 1 for a
    long one), plus ``lexical`` for the share of each utterance's words that the turn's last AGE
    utterances used, plus ``length``[n], n its utterances up to AGE. After an identified utterance
    length and memory begin anew: what stands between two of them is judged on its own.
    """

    def __init__(self, pause: float = 0.6, lexical: float = 0.8, turn: float = 0.5, length: tuple[float, ...] = (0.0,) * AGE, label: float = 0.0) -> None:
        self.pause, self.lexical, self.turn, self.length, self.label = pause, lexical, turn, tuple(length), label

    @property
    def reach(self) -> float:
        """More than all evidence but the labels can make of changing one utterance's speaker."""
        return 2 * abs(self.turn) + (AGE + 1) * abs(self.lexical) + 2 * abs(self.pause) + 3 * (max(self.length) - min(self.length)) + 1e-6

    @property
    def decisive(self) -> float:
        """The weight of an identified label: the fitted one, or just beyond reach."""
        return max(self.label, self.reach + 1.0)

    @staticmethod
    def silence(gap: float) -> float:
        return 1.0 - math.exp(-max(0.0, gap) / 2.0)

    @staticmethod
    def cohesion(bags: list[set[str]], m: int, age: int) -> float:
        """Share of m's words that the ``age`` utterances before it used."""
        if not bags[m]:
            return 0.0
        used: set[str] = set().union(*bags[max(0, m - age) : m])
        return len(bags[m] & used) / len(bags[m])

    def segment(self, labels: list[str], t: list[float], end: list[float], words: list[str], own: bool) -> list[tuple[int, int, str, float]]:
        """(from, to, label, score) of the best segmentation; to is inclusive.

        Viterbi over (speaker, age of the turn). Besides its own label an utterance may take those of
        the identified utterances next to it. States that lie further back than ``reach`` can't win
        any more and are left, so labelled speech takes constant time an utterance.
        """
        n = len(labels)
        if not n:
            return []
        sure = [own or y != UNKNOWN for y in labels]
        left: list[str | None] = [None] * n
        right: list[str | None] = [None] * n
        for k in range(1, n):
            left[k] = labels[k - 1] if sure[k - 1] else left[k - 1]
        for k in range(n - 2, -1, -1):
            right[k] = labels[k + 1] if sure[k + 1] else right[k + 1]
        bags = [set(w.split()) for w in words]
        weight, reach, length = self.decisive, self.reach, self.length
        front: dict[tuple[str, int], float] = {}
        back: list[dict[tuple[str, int], tuple[str, int] | None]] = []
        best_at: list[float] = []
        for m in range(n):
            names = {y for y in (labels[m] if sure[m] else None, left[m], right[m]) if y is not None} or {UNKNOWN}
            now: dict[tuple[str, int], float] = {}
            come: dict[tuple[str, int], tuple[str, int] | None] = {}
            still = self.pause * self.silence(t[m] - end[m - 1]) if m else 0.0
            ranked = sorted(front, key=front.get, reverse=True)
            for y in names:
                gain = weight if sure[m] and y == labels[m] else 0.0
                prev = next((x for x in ranked if x[0] != y), None)
                if not m or prev is not None:
                    now[y, 1] = (front[prev] if m else 0.0) + gain - self.turn + length[0]
                    come[y, 1] = prev
                for a in range(1, AGE + 1):
                    if (y, a) not in front:
                        continue
                    value = front[y, a] + gain - still + (self.lexical * self.cohesion(bags, m, a) if self.lexical else 0.0) + length[min(a, AGE - 1)] - length[a - 1]
                    to = (y, 1) if sure[m] and y == labels[m] else (y, min(a + 1, AGE))
                    if value > now.get(to, -math.inf):
                        now[to], come[to] = value, (y, a)
            top = max(now.values())
            front = {k: v for k, v in now.items() if v >= top - reach - 1.0}
            back.append(come)
            best_at.append(top)
        at: tuple[str, int] | None = max(front, key=lambda k: (front[k], k))
        path: list[str] = []
        for m in range(n - 1, -1, -1):
            path.append(at[0])
            at = back[m][at]
        path.reverse()
        out, i = [], 0
        for j in range(n):
            if j + 1 == n or path[j + 1] != path[j]:
                out.append((i, j, path[j], best_at[j] - (best_at[i - 1] if i else 0.0)))
                i = j + 1
        return out

    def features(self, path: list[str], labels: list[str], sure: list[bool], t: list[float], end: list[float], bags: list[set[str]]) -> dict[str, float]:
        """Sums of what the weights multiply along a given path."""
        f: dict[str, float] = {"turn": 0.0, "pause": 0.0, "lexical": 0.0}
        age = 0
        for m, y in enumerate(path):
            if m and path[m - 1] == y:
                f["pause"] -= self.silence(t[m] - end[m - 1])
                f["lexical"] += self.cohesion(bags, m, age)
                f[f"len{age}"] = f.get(f"len{age}", 0.0) - 1
                age = min(age + 1, AGE)
                f[f"len{age}"] = f.get(f"len{age}", 0.0) + 1
            else:
                f["turn"] -= 1
                age = 1
                f["len1"] = f.get("len1", 0.0) + 1
            if sure[m]:
                age = 1
        return f

    @classmethod
    def fit(cls, recordings: list[list[tuple[str, float, float, str]]], epochs: int = 5, hidden: float = 0.3, rate: float = 0.02, seed: int = 1) -> SegmentModel:
        """The averaged structured perceptron. recordings: rows (label, t, end, words) in order; a share
        of the labels is hidden, decoded and compared with what they were."""
        rng = random.Random(seed)
        model, total, steps = cls(), dict.fromkeys(("turn", "pause", "lexical", *(f"len{a}" for a in range(1, AGE + 1))), 0.0), 0
        w = {"turn": model.turn, "pause": model.pause, "lexical": model.lexical, **{f"len{a}": 0.0 for a in range(1, AGE + 1)}}
        make = lambda v: cls(v["pause"], v["lexical"], v["turn"], tuple(v[f"len{a}"] for a in range(1, AGE + 1)))
        for _ in range(epochs):
            for rows in recordings:
                truth, t, end, words = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
                shown = [UNKNOWN if rng.random() < hidden else y for y in truth]
                sure, bags = [y != UNKNOWN for y in shown], [set(x.split()) for x in words]
                got = [y for i, j, y, _ in make(w).segment(shown, t, end, words, own=False) for _ in range(i, j + 1)]
                if got != truth:
                    good, bad = model.features(truth, shown, sure, t, end, bags), model.features(got, shown, sure, t, end, bags)
                    for k in w:
                        w[k] += rate * (good.get(k, 0.0) - bad.get(k, 0.0))
                for k in w:
                    total[k] += w[k]
                steps += 1
        return make({k: v / steps for k, v in total.items()}) if steps else model


def fit_model(utts: DataFrame, recordings: int = 300, longest: int = 200, seed: int = 1) -> SegmentModel:
    """A model fitted on at most ``recordings`` recordings (the first by a seeded hash) of at most
    ``longest`` utterances, all of them identified."""
    u = clean_utterances(utts, with_text=False).filter("spoken")
    u = cut(u.select("recording_id", "utt_id", "label", "t", "end", "words"))
    fit = u.groupBy("recording_id").agg(F.count("*").alias("n"), F.bool_and(F.col("label") != UNKNOWN).alias("named"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    pick = fit.filter(F.col("named") & (F.col("n") <= longest) & (F.col("lo") != F.col("hi"))).orderBy(F.xxhash64(F.lit(seed), "recording_id"), "recording_id").limit(recordings)
    rows = u.join(F.broadcast(pick.select("recording_id")), "recording_id").orderBy("recording_id", "t", "utt_id").collect()  # at most recordings * longest rows
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["recording_id"], []).append((r["label"], r["t"], r["end"], r["words"]))
    return SegmentModel.fit(list(by.values()), seed=seed)


def _part_at_labels(u: DataFrame) -> DataFrame:
    """u with slices that begin at an identified utterance (the first of a recording may not), and the
    first utterance of the next slice at the end of each as context.

    Recordings in which nobody is identified keep their time slices.
    """
    order = ["t", "utt_id"]
    u = last_before(u, ["recording_id"], F.col("slice"), order, F.when(F.col("label") != UNKNOWN, F.col("slice")), "part")
    named = u.groupBy("recording_id").agg(F.bool_or(F.col("label") != UNKNOWN).alias("named"))
    u = u.join(named, "recording_id").withColumn("slice", F.when(F.col("named"), F.coalesce("part", F.lit(-1).cast("long"))).otherwise(F.col("slice"))).drop("part")
    u = cut(u)
    whole = F.struct(*[F.col(c) for c in u.columns])
    first = u.filter("named").groupBy("recording_id", "slice").agg(F.min_by(whole, F.struct(*order)).alias("row"))
    v = W.partitionBy("recording_id").orderBy("slice")
    ahead = first.withColumn("before", F.lag("slice").over(v)).filter("before is not null").select("before", "row.*").drop("slice").withColumnRenamed("before", "slice")
    return u.unionByName(ahead.withColumn("context", F.lit(True))).drop("named")


def speaker_turns(utts: DataFrame, *, unidentified: str = "own", model: SegmentModel | None = None, slice_s: float = SLICE_S, with_text: bool = True) -> DataFrame:
    """One row per turn: recording_id, turn_no, speaker_no, label, first_utt_id, last_utt_id,
    utterances, start, end, score, text (empty unless with_text).

    Null recordings or ids are left out, as are utterances without a spoken word. Without start an
    utterance has its place by its stamp, else its end, else it comes last; ties go by utt_id.
    Extra columns are ignored; empty tables give empty results.
    """
    own = unidentified == "own"
    model = model or SegmentModel()
    u = clean_utterances(utts, with_text).withColumn("slice", F.floor(F.col("t") / slice_s).cast("long")).withColumn("context", F.lit(False))
    if not with_text:
        u = u.withColumn("said", F.lit(""))
    if not own:
        u = _part_at_labels(cut(u.filter("spoken")))

    cols = ["recording_id", "slice", "k", "label", "first_utt_id", "last_utt_id", "n", "start", "end", "score", "text"]

    def segment(key: tuple, rows: list[tuple]) -> list[tuple]:
        ids, t, end, labels, words, said, _, context = zip(*rows)
        segs = model.segment(list(labels), list(t), list(end), list(words), own)
        if context[-1]:  # the next part's first utterance is here as evidence only
            segs = [(i, min(j, len(rows) - 2), y, s) for i, j, y, s in segs if i < len(rows) - 1]
        return [(*key, k, y, ids[i], ids[j], j - i + 1, t[i], max(end[i : j + 1]), s, " ".join(x for x in said[i : j + 1] if x)) for k, (i, j, y, s) in enumerate(segs)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Slices one after another from sorted rows; one slice is in memory at a time."""
        key, rows = None, []
        for pdf in parts:
            done: list[tuple] = []
            for r in zip(*(pdf[c].tolist() for c in ("recording_id", "slice", "utt_id", "t", "end", "label", "words", "said", "spoken", "context"))):
                if not r[8]:
                    continue
                if r[:2] != key:
                    done += segment(key, rows) if rows else []
                    key, rows = r[:2], []
                rows.append(r[2:])
            yield pd.DataFrame(done, columns=cols)
        if rows:
            yield pd.DataFrame(segment(key, rows), columns=cols)

    u = u.repartition("recording_id", "slice").sortWithinPartitions("recording_id", "slice", "context", "t", "utt_id")
    segs = cut(u.mapInPandas(run, "recording_id string, slice long, k long, label string, first_utt_id long, last_utt_id long, n long, start double, end double, score double, text string"))

    # join slices: a slice's first segment continues the turn before it if the labels agree
    per = segs.groupBy("recording_id", "slice").agg(F.count("*").alias("segs"), F.min_by("label", "k").alias("first"), F.max_by("label", "k").alias("last"))
    v = W.partitionBy("recording_id").orderBy("slice")
    per = per.withColumn("joins", F.coalesce(F.lag("last").over(v) == F.col("first"), F.lit(False)).cast("long"))
    per = per.withColumn("base", F.coalesce(F.sum(F.col("segs") - F.col("joins")).over(v.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("joins"))
    segs = segs.join(per.select("recording_id", "slice", "base"), ["recording_id", "slice"]).withColumn("turn_no", F.col("base") + F.col("k") + 1)
    order = F.struct("slice", "k")
    turns = segs.groupBy("recording_id", "turn_no").agg(
        F.min_by("label", order).alias("label"),
        F.min_by("first_utt_id", order).alias("first_utt_id"),
        F.max_by("last_utt_id", order).alias("last_utt_id"),
        F.sum("n").alias("utterances"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("score").alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "k", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    first = segs.groupBy("recording_id", "label").agg(F.min("turn_no").alias("at"))
    first = first.withColumn("speaker_no", F.row_number().over(W.partitionBy("recording_id").orderBy("at")).cast("long")).drop("at")
    return turns.join(first, ["recording_id", "label"])


def found(utts: DataFrame) -> DataFrame:
    return speaker_turns(utts, with_text=False).select("recording_id", "turn_no", "speaker_no", "first_utt_id", "last_utt_id")
