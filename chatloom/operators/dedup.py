"""Removing repeats within one archive: first occurrences and the fold of media variants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.chat import message_id

POLICIES = ("reference", "omitted_only")


def with_id(rows: DataFrame) -> DataFrame:
    """rows with message_id; null senders and contents count as empty."""
    c = lambda n: F.coalesce(n, F.lit(""))
    return rows.withColumn("message_id", message_id(c("timestamp"), c("sender"), c("content"), F.col("media_file")))


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate, so copies of a hot key are merged before the shuffle; a window would sort them.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("__first")).select("__first.*")


def fold_group(rows: list[tuple], policy: str = "reference") -> list[tuple]:
    """Rows (pos, id, has_media, omitted) of one (archive, timestamp, sender) in order -> the rows
    that stay as (slot position, pos of the row that stands there).

    An omitted row gives way to a row with the file; under ``reference`` every later file takes the
    same slot again, under ``omitted_only`` a slot is filled once.
    """
    seen: set = set()
    out: list[list] = []  # [slot pos, row]
    slot = None
    any_media = any(r[2] for r in rows)
    for r in rows:
        pos, rid, media, omitted = r
        if rid in seen:
            continue
        if omitted:
            if (slot is not None and out[slot][1][2]) or any_media and any(o[1][2] for o in out):
                continue
            out.append([pos, r])
            slot = len(out) - 1
            seen.add(rid)
        elif media and slot is not None:
            seen.discard(out[slot][1][1])
            out[slot][1] = r
            seen.add(rid)
            if policy == "omitted_only":
                slot = None
        else:
            out.append([pos, r])
            seen.add(rid)
    return [(p, r[0]) for p, r in out]


def dedup_archive(rows: DataFrame, policy: str = "reference") -> DataFrame:
    """rows (schema PARSED) without repeats, with message_id and ``slot`` (the place in the output).

    Only groups that mix omitted rows with others need the fold; the rest keep first occurrences in
    the JVM. The fold streams over sorted partitions, one group in memory at a time.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rows = with_id(rows)
    keys = ["source_zip", "timestamp", "sender"]
    need = rows.groupBy(*keys).agg((F.bool_or("is_media_omitted") & (F.count("*") > 1)).alias("__fold")).filter("__fold")
    null_safe = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    calm = rows.join(need, null_safe(rows, need), "left_anti")
    calm = first_occurrence(calm, ["source_zip", "message_id"], ["pos"]).withColumn("slot", F.col("pos").cast("long"))
    busy = rows.join(need, null_safe(rows, need), "left_semi").select(*keys, "pos", "message_id", F.col("media_file").isNotNull().alias("m"), F.coalesce("is_media_omitted", F.lit(False)).alias("o"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []
        done: list[tuple] = []

        def close() -> None:
            if group:
                done.extend((key[0], *x) for x in fold_group(group, policy))

        for pdf in parts:
            for r in pdf.itertuples(index=False):
                k = (r.source_zip, r.timestamp, r.sender)
                if k != key:
                    close()
                    key, group = k, []
                group.append((r.pos, r.message_id, r.m, r.o))
            if done:
                yield pd.DataFrame(done, columns=["source_zip", "slot", "pos"])
                done = []
        close()
        if done:
            yield pd.DataFrame(done, columns=["source_zip", "slot", "pos"])

    kept = busy.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInPandas(run, "source_zip string, slot long, pos long")
    return calm.unionByName(rows.join(kept, ["source_zip", "pos"]))
