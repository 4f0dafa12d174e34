"""Mixing sources to target weights (problem 9).

Method: capped water-filling. Each source may give at most max_repeats times its tokens; a source
whose wanted amount exceeds that is clamped and the rest is shared among the others in proportion
to their targets, until nothing is above its cap. The amount is drawn as whole repetitions of all
records plus a seeded fraction of one more.

Scale: token counts are one Arrow pass. Per source only sums reach the driver (sources are those of
the targets table). The fractional draw orders records by a seeded hash without sorting a source:
sums per hash bucket find the bucket where the quota ends, and only that bucket is ordered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.session import cut, small

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKETS = 1 << 14


# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of each whole text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        path = Path(tokenizer)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in parts:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return df.withColumn(out, count(F.coalesce(F.col(text), F.lit(""))))


def water_fill(targets: dict[str, tuple[float, float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source. targets: source -> (share, tokens available, max repeats).

    total None: the largest total at which every source that has tokens can hold its share exactly.
    A source with share 0, nothing available or no repeats gets 0; its share goes to the rest.
    """
    caps = {s: max(0, n * r) for s, (_, n, r) in targets.items()}
    live = {s: w for s, (w, _, _) in targets.items() if w and w > 0 and caps[s] > 0}
    if total is None:
        norm = sum(live.values())
        total = min((caps[s] * norm / w for s, w in live.items()), default=0.0)
    take, left = dict.fromkeys(targets, 0.0), float(total)
    while live and left > 1e-9:
        norm = sum(live.values())
        over = [s for s, w in live.items() if left * w / norm >= caps[s] - take[s] - 1e-9]
        if not over:
            for s, w in live.items():
                take[s] += left * w / norm
            break
        gone = 0.0
        for s in over:
            gone += caps[s] - take[s]
            take[s] = float(caps[s])
            del live[s]
        left -= gone
    return take


def mix(
    documents: DataFrame, targets: DataFrame, *, total: float | None = None, share_of_all: float | None = None, seed: int = 42, source: str = "source",
    text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, size: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, tokens, copies (>= 1), one row per record used.
    report: source, target_share, max_repeats, available, wanted, taken, share.

    Sizes are tokens, or ``size`` if it is given. The wanted total is ``total``, or ``share_of_all``
    of the size of all usable records; without both, the largest at which every source holds its share.
    Records without a source of ``targets``, without id or without tokens are not used (the report
    counts what is available). Each source's fraction ends at the last whole record that fits, so
    it falls short by less than one record. Repeated target rows count once (the smallest).
    """
    t = targets.filter("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("v")).select("source", "v.*")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), (F.lit(None) if size is None else size).cast("long").alias("tokens"))
    docs = (count_tokens(docs, tokenizer=tokenizer) if size is None else docs).drop("text")
    docs = docs.filter("doc_id is not null and tokens > 0").join(small(t.select("source")), "source", "left_semi")
    docs = cut(docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS))))
    have = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rows = t.collect()
    if share_of_all is not None:
        total = share_of_all * sum(have.values())
    wanted = water_fill({r["source"]: (r["target_share"] or 0.0, have.get(r["source"], 0), r["max_repeats"] or 0) for r in rows}, total)
    plan = []
    for r in rows:
        n = have.get(r["source"], 0)
        whole = min(int(wanted[r["source"]] // n), r["max_repeats"] or 0) if n else 0
        quota = wanted[r["source"]] - whole * n if n else 0.0
        plan.append((r["source"], r["target_share"], r["max_repeats"], n, wanted[r["source"]], whole, quota if whole < (r["max_repeats"] or 0) else 0.0))
    p = documents.sparkSession.createDataFrame(plan, "source string, target_share double, max_repeats int, available long, wanted double, whole long, quota double")
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    docs = docs.join(small(p.select("source", "whole", "quota")), "source")
    docs = docs.join(before.select("source", "bucket", "n", "before"), ["source", "bucket"])
    inside = F.col("before") + F.col("n") <= F.col("quota")
    edge = ~inside & (F.col("before") < F.col("quota"))
    w = W.partitionBy("source").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    cols = ["doc_id", "source", "tokens", "whole"]
    taken = (
        docs.filter(~edge).select(*cols, inside.cast("long").alias("extra"))
        .unionByName(docs.filter(edge).withColumn("upto", F.col("before") + F.sum("tokens").over(w)).select(*cols, (F.col("upto") <= F.col("quota")).cast("long").alias("extra")))
    )
    out = taken.select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")).filter("copies > 0")
    got = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    # one row per target at most, and the targets are in the driver already
    report = p.drop("whole", "quota").join(F.broadcast(got), "source", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    total_taken = F.sum("taken").over(W.partitionBy())
    return out, report.withColumn("share", F.when(total_taken > 0, F.col("taken") / total_taken).otherwise(0.0))
