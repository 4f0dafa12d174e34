"""The message index: merging archives, contact facts, votes, snapshots."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import chat
from chatloom.functions.periods import lenient_date, period_label
from chatloom.operators.dedup import POLICIES
from chatloom.operators.ordering import number_rows
from chatloom.session import cut
from chatloom.sources import files

SLICE = 8192


class Fold:
    """What merging does to the messages of one (timestamp, sender), in order: first the index's rows,
    then new rows archive by archive. An id holds timestamp and sender, so nothing outside matters.

    Only ids and, per contact, the rows that the next one may be compared with are kept.
    """

    def __init__(self, policy: str) -> None:
        self.policy = policy
        self.ids: set[str] = set()
        self.media: dict[str, dict] = {}  # contact -> a row that has its file
        self.last: dict[str, dict] = {}  # contact -> the row that came last
        self.now: tuple | None = None  # (contact, archive) being merged
        self.cur: dict | None = None  # the row a media row may replace

    def _keep(self, contact: str, row: dict) -> None:
        self.ids.add(row["id"])
        self.last[contact] = row
        if row["media"]:
            self.media.setdefault(contact, row)

    def old(self, contact: str, seq: int, rid: str, media: bool, omitted: bool) -> None:
        self._keep(contact, {"id": rid, "media": media, "omitted": omitted, "row": None, "seq": seq, "at": (None, None)})

    def new(self, contact: str, archive: int, pos: int, rid: str, media: bool, omitted: bool) -> list[tuple]:
        """Events (contact, action, archive, pos, seq, at_archive, at_pos); ``at`` is the place in this
        run that a row has, its own or that of the row it replaces."""
        if (contact, archive) != self.now:
            self.now, self.cur = (contact, archive), self.media.get(contact) or self.last.get(contact)
        cur, out = self.cur, []
        if rid in self.ids:
            return [(contact, "skipped", archive, pos, None, None, None)]
        row = {"id": rid, "media": media, "omitted": omitted, "row": (archive, pos)}
        if media and cur is not None and not cur["media"] and (self.policy == "reference" or cur["omitted"]):
            self.ids.discard(cur["id"])
            row |= {"seq": cur["seq"], "at": cur["at"]}
            out = [(contact, "deleted", None, None, cur["seq"], None, None) if cur["row"] is None else (contact, "replaced", *cur["row"], None, None, None)]
            out.append((contact, "upgraded", archive, pos, cur["seq"], *cur["at"]))
        elif omitted and cur is not None and cur["media"]:
            return [(contact, "skipped", archive, pos, None, None, None)]
        else:
            row |= {"seq": None, "at": (archive, pos)}
            out = [(contact, "added", archive, pos, None, archive, pos)]
        self._keep(contact, row)
        self.cur = row
        return out


ACTS = "contact string, action string, archive int, pos long, seq long, at_archive int, at_pos long"


def merge_archives(index: DataFrame, new: DataFrame, policy: str = "reference") -> DataFrame:
    """What happens to the rows of ``new`` when their archives are merged into ``index`` one after the
    other, in one pass: contact, archive, pos, action, seq.

    new: message_id, contact, archive (its order), slot, timestamp, sender, media_file,
    is_media_omitted. index: message_id, contact, seq, timestamp, sender, media_file and, for
    ``omitted_only``, is_media_omitted. Actions: added, skipped, upgraded (takes the place of a row
    without its file), replaced (a row of this run that gave its place away), deleted (an index row
    that did; no archive). seq is the row's place: added rows are numbered on from their contact's
    largest seq in the order of archives and slots. (contact, archive, slot) must be unique.

    Only groups with both rows that have files and rows that have none need the ordered fold; the
    rest are first occurrences and anti joins.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    omitted = F.coalesce("is_media_omitted", F.lit(False)) if "is_media_omitted" in index.columns else F.lit(False)
    none = lambda kind: F.lit(None).cast(kind)
    keys = ["timestamp", "sender"]
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    fresh = new.select(*keys, "contact", F.col("archive").cast("int").alias("archive"), F.col("slot").cast("long").alias("n"), "message_id", F.col("media_file").isNotNull().alias("m"), F.coalesce("is_media_omitted", F.lit(False)).alias("o"))
    old = index.select(*keys, "contact", none("int").alias("archive"), F.col("seq").cast("long").alias("n"), "message_id", F.col("media_file").isNotNull().alias("m"), omitted.alias("o"))
    asked = fresh.select(*keys).distinct()
    old = old.join(asked, same(old, asked), "left_semi")
    both = cut(old.unionByName(fresh))
    mixed = both.groupBy(*keys).agg(F.bool_or("m").alias("some"), F.bool_and("m").alias("every"), F.bool_or(F.col("archive").isNotNull()).alias("new")).filter("some and not every and new").select(*keys)

    calm = both.join(mixed, same(both, mixed), "left_anti")
    place = F.struct("archive", "contact", "n")
    held = calm.filter("archive is null").select("message_id").distinct().withColumn("held", F.lit(True))
    first = calm.filter("archive is not null").groupBy("message_id").agg(F.min(place).alias("first"))
    plain = calm.filter("archive is not null").join(held, "message_id", "left").join(first, "message_id")
    is_new = F.col("held").isNull() & (place == F.col("first"))
    plain = plain.select("contact", F.when(is_new, "added").otherwise("skipped").alias("action"), "archive", F.col("n").alias("pos"), none("long").alias("seq"), F.when(is_new, F.col("archive")).alias("at_archive"), F.when(is_new, F.col("n")).alias("at_pos"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = object(), Fold(policy)
        for pdf in parts:
            done: list[tuple] = []
            for ts, who, contact, archive, n, rid, m, o in zip(*(pdf[c].tolist() for c in (*keys, "contact", "archive", "n", "message_id", "m", "o"))):
                if (ts, who) != key:
                    key, fold = (ts, who), Fold(policy)
                if archive is None or archive != archive:
                    fold.old(contact, n, rid, m, o)
                else:
                    done += fold.new(contact, int(archive), n, rid, m, o)
            yield _frame(done)

    busy = both.join(mixed, same(both, mixed), "left_semi").repartition(*keys).sortWithinPartitions(*keys, F.col("archive").asc_nulls_first(), "contact", "n")
    acts = cut(plain.unionByName(busy.mapInPandas(run, ACTS)))
    # a row that is added and then gives its place away is only replaced
    row = ["contact", "archive", "pos"]
    gone = acts.filter("action = 'replaced'").select(*row)
    acts = acts.filter("action in ('replaced', 'deleted', 'skipped')").unionByName(acts.filter("action in ('added', 'upgraded')").join(gone, row, "left_anti"))
    # each place of the run is numbered once, whichever row has it in the end
    top = index.groupBy("contact").agg(F.max("seq").alias("top"))
    places = acts.filter("at_archive is not null").select("contact", "at_archive", "at_pos").distinct()
    places = number_rows(places, ["contact"], F.struct("at_archive", F.floor(F.col("at_pos") / SLICE)), ["at_archive", "at_pos"], "nth").join(top, "contact", "left")
    places = places.select("contact", "at_archive", "at_pos", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("place"))
    out = acts.join(places, ["contact", "at_archive", "at_pos"], "left")
    return out.select("contact", "archive", "pos", "action", F.coalesce("seq", "place").alias("seq"))


def merge_archive(index: DataFrame, new: DataFrame, contact: str | None = None, policy: str = "reference") -> DataFrame:
    """merge_archives of one archive: pos, action, seq; all rows of ``new`` go to ``contact``. Without
    one each goes to the contact in its own column, the contacts merge one after the other by name,
    and the result has a column contact."""
    to = F.col("contact") if contact is None else F.lit(contact)
    out = merge_archives(index, new.withColumn("contact", to).withColumn("archive", F.lit(1)), policy).drop("archive")
    return out if contact is None else out.drop("contact")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in ACTS.split(", ")]
    whole = {n: "Int64" for n in ("archive", "pos", "seq", "at_archive", "at_pos")}
    return pd.DataFrame(rows, columns=names).astype(whole)


def apply_merge(index: DataFrame, new: DataFrame, acts: DataFrame, interval: str = "1w") -> DataFrame:
    """The index after merge_archives (schema MESSAGES plus content and is_media_omitted if present)."""
    kept = index.join(acts.filter("action = 'deleted'").select("contact", "seq"), ["contact", "seq"], "left_anti")
    stay = acts.filter("action in ('added', 'upgraded')").select("contact", "archive", F.col("pos").alias("slot"), "seq")
    rows = new.join(stay, ["contact", "archive", "slot"]).withColumns({"media_processed": F.lit(False), "period": period_label(lenient_date(F.col("timestamp")), interval)})
    return kept.unionByName(rows.select(*[c for c in index.columns if c in rows.columns]), allowMissingColumns=True)


def overlap_votes(index: DataFrame, new: DataFrame, archives: DataFrame) -> DataFrame:
    """source_zip, contact, holder, votes, first: how many messages of each archive (of ``new``) a
    contact of the index holds already or, where none does, an earlier archive of ``new`` (the first
    that holds the id), and the first slot of them. archives: source_zip, zip_order."""
    ids = new.groupBy("source_zip", "message_id").agg(F.min("slot").alias("slot"), F.count("*").alias("n")).join(archives.select("source_zip", "zip_order"), "source_zip")
    known = index.groupBy("message_id").agg(F.min("contact").alias("contact"))
    first = ids.groupBy("message_id").agg(F.min(F.struct("zip_order", "source_zip")).alias("h"))
    votes = ids.join(known, "message_id", "left").join(first, "message_id")
    votes = votes.filter("contact is not null or h.zip_order < zip_order").withColumn("holder", F.when(F.col("contact").isNull(), F.col("h.source_zip")))
    return votes.groupBy("source_zip", "contact", "holder").agg(F.sum("n").alias("votes"), F.min("slot").alias("first"))


def resolve_contacts(index: DataFrame, new: DataFrame, archives: DataFrame, threshold: float = 0.3) -> dict[str, str]:
    """source_zip -> contact its messages go to: the one that already holds more than ``threshold`` of
    them, else the archive's own name.

    Archives are taken in order, and each may go where an earlier one of this run went. The joins are
    on ids; what reaches the driver is one count per archive and holder, of the archives of one run.
    """
    got: dict[str, list] = {}
    for r in overlap_votes(index, new, archives).collect():
        got.setdefault(r["source_zip"], []).append(r)
    total = {r["source_zip"]: r["n"] for r in new.groupBy("source_zip").agg(F.count("*").alias("n")).collect()}
    went: dict[str, str] = {}
    for a in archives.orderBy("zip_order").select("source_zip", "contact_name").collect():
        name, sums = a["contact_name"], {}
        for r in got.get(a["source_zip"], ()):
            at = r["contact"] or went[r["holder"]]
            if at != name:
                n, first_slot = sums.get(at, (0, r["first"]))
                sums[at] = (n + r["votes"], min(first_slot, r["first"]))
        best = max(sums, key=lambda c: (sums[c][0], -sums[c][1], c), default=None)
        went[a["source_zip"]] = best if best is not None and sums[best][0] / total[a["source_zip"]] > threshold else name
    return went


def register_media(known: DataFrame, entries: DataFrame) -> DataFrame:
    """The media table with entries (contact, filename, source_zip, zip_order, stored_name) that it
    doesn't hold yet, as pending; of several archives the first gives the entry."""
    fresh = entries.join(known.select("contact", "filename"), ["contact", "filename"], "left_anti")
    one = fresh.groupBy("contact", "filename").agg(F.min(F.struct("zip_order", "source_zip", "stored_name")).alias("v"))
    rows = one.select("contact", "filename", F.lit("pending").alias("status"), chat.media_subtype(F.col("filename")).alias("type"), "v.source_zip", "v.stored_name", F.lit(None).cast("string").alias("transcription"), F.lit(None).cast("string").alias("error"))
    return known.unionByName(rows)


def update_media(media: DataFrame, results: DataFrame) -> DataFrame:
    """The media table after processing; results: contact, filename, status, transcription, error."""
    r = results.select("contact", "filename", F.col("status").alias("s"), F.col("transcription").alias("t"), F.col("error").alias("e"))
    joined = media.join(r, ["contact", "filename"], "left")
    hit = F.col("s").isNotNull()
    return joined.withColumns({"status": F.coalesce("s", "status"), "transcription": F.when(hit, F.col("t")).otherwise(F.col("transcription")), "error": F.when(hit, F.col("e")).otherwise(F.col("error"))}).drop("s", "t", "e")


def attach_media(messages: DataFrame, media: DataFrame) -> DataFrame:
    """messages with transcription (of processed files), media_exists and stored_name (the name a file
    was staged under; its own if that was free), by (contact, media_file)."""
    m = media.select("contact", F.col("filename").alias("media_file"), "stored_name", F.when(F.col("status") == "processed", F.col("transcription")).alias("transcription"), F.lit(True).alias("__there"))
    return messages.join(m, ["contact", "media_file"], "left").withColumn("media_exists", F.coalesce("__there", F.lit(False))).withColumn("stored_name", F.coalesce("stored_name", "media_file")).drop("__there")


def contact_counts(messages: DataFrame) -> DataFrame:
    """contact, message_count, max_seq."""
    return messages.groupBy("contact").agg(F.count("*").alias("message_count"), F.max("seq").alias("max_seq"))


def contact_periods(messages: DataFrame) -> DataFrame:
    """The distinct periods of each contact."""
    return messages.select("contact", "period").distinct()


def periods_of(messages: DataFrame, contact: str) -> DataFrame:
    """The periods of one contact, in order."""
    return messages.filter(F.col("contact") == contact).select("period").distinct().orderBy("period")


def messages_of(messages: DataFrame, contact: str, period: str | None = None) -> DataFrame:
    """The messages of one contact, or of one of its periods, by seq."""
    scope = F.col("contact") == contact
    return messages.filter(scope if period is None else scope & (F.col("period") == period)).orderBy("seq")


def contact_ids(messages: DataFrame, contact: str) -> DataFrame:
    """The message ids of one contact."""
    return messages.filter(F.col("contact") == contact).select("message_id").distinct()


def detect_self(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """self_name: the one sender present in all contacts (contact, sender), if there is more than one
    contact; an empty result where there is none or several. Empty senders don't count. With ``by``,
    one row (by, self_name) for each of its values, over the contacts of that value."""
    keys = [by] if by else []
    pairs = pairs.filter("contact is not null and sender is not null and sender != ''").select(*keys, "contact", "sender").distinct()
    n = pairs.groupBy(*keys).agg(F.countDistinct("contact").alias("n"))
    seen = pairs.groupBy(*keys, "sender").agg(F.count("*").alias("seen"))
    full = (seen.join(n, by) if by else seen.join(F.broadcast(n))).filter("seen = n and n > 1")
    return full.groupBy(*keys).agg(F.count("*").alias("c"), F.min("sender").alias("self_name")).filter("c = 1").select(*keys, "self_name")


def group_test(messages: DataFrame, key: str = "source_zip") -> DataFrame:
    """key, is_group: a group-only system message, or more than two senders of other messages."""
    low, system = F.lower(F.coalesce("content", F.lit(""))), F.col("type") == "system"
    sign = F.lit(False)
    for phrase in chat.GROUP_SIGNS:
        sign = sign | low.contains(phrase)
    who = F.when(~system & (F.col("sender") != ""), F.col("sender"))
    # three distinct senders are enough to know, so distinct pairs are counted after a pre-aggregate
    pairs = messages.select(key, who.alias("w"), F.coalesce(system & sign, F.lit(False)).alias("s")).groupBy(key, "w").agg(F.bool_or("s").alias("s"))
    return pairs.groupBy(key).agg((F.bool_or("s") | (F.count("w") > 2)).alias("is_group"))


def latest_meta(archives: DataFrame) -> DataFrame:
    """Per contact the format and encoding of the last archive, and all archives in order."""
    return archives.groupBy("contact_name").agg(
        F.max_by("detected_format", "zip_order").alias("date_format"),
        F.max_by("encoding", "zip_order").alias("encoding"),
        F.transform(F.array_sort(F.collect_list(F.struct("zip_order", "source_zip"))), lambda x: x["source_zip"]).alias("source_zips"),
    )


def save_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables as a new snapshot and switch the pointer; what is read is never overwritten."""
    name = f"v{time.time_ns()}"
    for table, df in tables.items():
        df.write.parquet(files.join(root, name, table))
    pointer = {"version": 1, "snapshot": name, "tables": sorted(tables)}
    files.write_bytes(files.join(root, "current.json"), json.dumps(pointer).encode())
    return name


def load_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The tables of the current snapshot, None if there is none."""
    pointer = files.join(root, "current.json")
    if not files.exists(pointer):
        return None
    at = json.loads(files.read_bytes(pointer))
    base = files.join(root, at["snapshot"])
    return {t: spark.read.parquet(files.join(base, t)) for t in at.get("tables") or files.listing(base)}
