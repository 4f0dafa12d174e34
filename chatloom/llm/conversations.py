"""Rebuilding conversations from message rows (problem 2).

Method: sessionize. Rows of a contact are put in time order, cut where the silence is longer than
a gap calibrated on the corpus and given roles; sessions without reciprocal replies are dropped.
``drop_reasons`` judges whole contacts, as the data's own rule does: their sessions' speakers are
put together, so there the place of a cut has no effect.

Scale: nothing is ordered over a whole contact at once. Order checks run in slices (contact, run
of ``SLICE`` sequence numbers) and (contact, day); what crosses a slice border is compared in a
second, small window over one row per slice, so one contact may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import sender_key
from chatloom.operators.ordering import number_rows
from chatloom.session import cut

SLICE = 1024
#: Bins of log2(gap + 1 s) used for calibration: a fixed number, whatever the corpus.
BINS = 40


def _seconds(c: Column) -> Column:
    return F.unix_seconds(F.concat(F.translate(F.substring(F.trim(c), 1, 19), "T", " "), F.lit("Z")).try_cast("timestamp"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per (contact, message_id), the smallest (seq, timestamp). Rows without an id are one
    message if they agree in everything."""
    row = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in ("seq", "timestamp", "sender", "type", "source_zip")])
    key = F.coalesce(F.unhex("message_id"), F.encode(F.coalesce("message_id", F.concat(F.lit("row "), row)), "utf-8"))
    m = messages.select(
        "contact",
        key.alias("id"),
        F.struct(
            F.col("seq"),
            _seconds(F.col("timestamp")).alias("t"),
            sender_key(F.col("sender")).alias("who"),
            F.col("type").isin("text", "media").alias("said"),
            F.col("source_zip"),
            F.col("message_id"),
        ).alias("v"),
    ).filter("contact is not null")
    return m.groupBy("contact", "id").agg(F.min("v").alias("v")).select("contact", "v.*")


def order_faults(rows: DataFrame) -> DataFrame:
    """Per contact: is seq not 1, 2, 3 … without hole or repetition, or does t run backwards?"""
    nameless = rows.filter("seq is null").select("contact", F.lit(True).alias("bad"))
    rows = rows.filter("seq is not null").withColumn("slice", F.floor(F.col("seq") / SLICE))
    w = W.partitionBy("contact", "slice").orderBy("seq", "t")
    step, back = F.col("seq") - F.lag("seq").over(w), F.col("t") < F.lag("t").over(w)
    local = rows.select("contact", "slice", "seq", "t", (F.coalesce(step != 1, F.lit(False)) | F.coalesce(back, F.lit(False))).alias("bad"))
    per = local.groupBy("contact", "slice").agg(
        F.bool_or("bad").alias("bad"),
        F.min("seq").alias("lo"),
        F.max("seq").alias("hi"),
        F.min(F.when(F.col("t").isNotNull(), F.struct("seq", "t")))["t"].alias("t_lo"),
        F.max(F.when(F.col("t").isNotNull(), F.struct("seq", "t")))["t"].alias("t_hi"),
    )
    v = W.partitionBy("contact").orderBy("slice")
    hole = F.col("lo") != F.coalesce(F.lag("hi").over(v), F.lit(0)) + 1
    # the last time before a slice, also over slices without any
    back = F.col("t_lo") < F.last("t_hi", ignorenulls=True).over(v.rowsBetween(W.unboundedPreceding, -1))
    return (
        per.select("contact", (F.col("bad") | F.coalesce(hole, F.lit(True)) | F.coalesce(back, F.lit(False))).alias("bad"))
        .unionByName(nameless)
        .groupBy("contact")
        .agg(F.bool_or("bad").alias("broken"))
    )


def with_gaps(rows: DataFrame) -> DataFrame:
    """rows with ``gap``: seconds since the row before in time (null for a contact's first)."""
    rows = rows.withColumn("day", F.floor(F.col("t") / 86400))
    w = W.partitionBy("contact", "day").orderBy("t", "seq", "who")
    local = rows.withColumn("before", F.lag("t").over(w))
    v = W.partitionBy("contact").orderBy("day")
    days = rows.groupBy("contact", "day").agg(F.max("t").alias("end")).withColumn("before_day", F.lag("end").over(v)).drop("end")
    return (
        local.join(days, ["contact", "day"])
        .withColumn("gap", F.col("t") - F.coalesce("before", "before_day"))
        .drop("before", "before_day")
    )


def calibrated_gap(rows: DataFrame, bins: int = BINS) -> int:
    """The silence, in seconds, that best parts short pauses from long ones.

    A histogram of log2 gaps over all rows (``bins`` rows reach the driver), cut where the
    variance between the two sides is largest (Otsu). A day if there are no gaps.
    """
    hist = rows.filter("gap is not null").groupBy(F.least(F.floor(F.log2(F.col("gap") + 1)), F.lit(bins - 1)).alias("b")).count().collect()
    n = {int(r["b"]): r["count"] for r in hist}
    total, mass = sum(n.values()), sum(b * c for b, c in n.items())
    best, at, c0, m0 = -1.0, None, 0, 0
    for b in range(bins):
        c0, m0 = c0 + n.get(b, 0), m0 + b * n.get(b, 0)
        if 0 < c0 < total:
            score = c0 * (total - c0) * (m0 / c0 - (mass - m0) / (total - c0)) ** 2
            if score > best:
                best, at = score, b
    return 86400 if at is None else 2 ** (at + 1)


def sessions(rows: DataFrame, gap: int | None = None) -> DataFrame:
    """rows (of distinct_messages, with a time) plus session_no, from 1 in each contact."""
    rows = with_gaps(rows.filter("t is not null"))
    if gap is None:
        rows = cut(rows)
        gap = calibrated_gap(rows)
    new = F.coalesce(F.col("gap") > gap, F.lit(True)).cast("long")
    w = W.partitionBy("contact", "day").orderBy("t", "seq", "who").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("new", new).withColumn("k", F.sum("new").over(w))
    v = W.partitionBy("contact").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = rows.groupBy("contact", "day").agg(F.sum("new").alias("n")).select("contact", "day", F.coalesce(F.sum("n").over(v), F.lit(0)).alias("base"))
    return rows.join(days, ["contact", "day"]).withColumn("session_no", F.col("base") + F.col("k")).drop("base", "k", "new", "day")


def owners(rows: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Per contact the account owner's key: the ``self`` most of its exports name, else the sender
    seen in most contacts, if in more than one; ties go to the smaller key."""
    pairs = rows.filter(F.col("said") & F.col("who").isNotNull()).groupBy("contact", "who").agg(F.count("*").alias("n"))
    wide = pairs.groupBy("who").agg(F.count("*").alias("seen")).filter("seen > 1")
    by_seen = pairs.join(wide, "who").groupBy("contact").agg(F.max(F.struct("seen", "who"))["who"].alias("seen_owner"))
    out = by_seen
    if options is not None:
        named = options.select("source_zip", sender_key(F.col("self")).alias("me")).filter("me is not null").distinct()
        zips = rows.groupBy("contact", "source_zip").agg(F.count("*").alias("n"))
        told = zips.join(named, "source_zip").groupBy("contact", "me").agg(F.sum("n").alias("n")).groupBy("contact").agg(F.max(F.struct("n", "me"))["me"].alias("told_owner"))
        out = by_seen.join(told, "contact", "full_outer").select("contact", F.coalesce("told_owner", "seen_owner").alias("owner"))
        return out
    return out.select("contact", F.col("seen_owner").alias("owner"))


def _said() -> Column:
    return F.col("said") & F.col("who").isNotNull()


def rebuild_conversations(messages: DataFrame, options: DataFrame | None = None, gap: int | None = None) -> DataFrame:
    """One row per session: contact, session_no, first and last second, rows, owner_rows,
    other_rows, two_sided (at least two senders said something), lo_who and hi_who (smallest and
    largest sender key, enough to merge reciprocity over sessions), reason (empty or no_reply where
    a session is to be dropped).

    Null contacts are left out; rows without readable time belong to no session. Repeated rows
    count once. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = cut(distinct_messages(messages))
    s = sessions(rows, gap).join(owners(rows, options), "contact", "left")
    said = _said()
    per = s.groupBy("contact", "session_no").agg(
        F.min("t").alias("first_sec"),
        F.max("t").alias("last_sec"),
        F.count("*").alias("rows"),
        F.count_if(said & F.col("who").eqNullSafe(F.col("owner"))).alias("owner_rows"),
        F.count_if(said & ~F.col("who").eqNullSafe(F.col("owner"))).alias("other_rows"),
        F.min(F.when(said, F.col("who"))).alias("lo_who"),
        F.max(F.when(said, F.col("who"))).alias("hi_who"),
    ).withColumn("two_sided", F.coalesce(F.col("lo_who") != F.col("hi_who"), F.lit(False)))
    return per.withColumn("reason", F.when(F.col("lo_who").isNull(), "empty").when(~F.col("two_sided"), "no_reply"))


def ordered_conversations(contacts: DataFrame, messages: DataFrame, options: DataFrame | None = None, gap: int | None = None) -> DataFrame:
    """One row per message of the usable conversations, once and in order: contact, session_no,
    place (from 1 in its session), message_id, seq, t, who, role (owner, other, or system where
    nobody speaks).

    Dropped are contacts with a reason of drop_reasons, contacts that ``contacts`` doesn't list, and
    of the others the sessions in which nobody replies (rebuild_conversations gives their reason).
    """
    rows = cut(distinct_messages(messages))
    bad = _reasons(contacts, rows, gap)
    usable = contacts.select("contact").filter("contact is not null").distinct().join(bad, "contact", "left_anti")
    said = _said()
    s = cut(sessions(rows, gap).join(usable, "contact", "left_semi").join(owners(rows, options), "contact", "left"))
    per = s.groupBy("contact", "session_no").agg(F.min(F.when(said, F.col("who"))).alias("lo"), F.max(F.when(said, F.col("who"))).alias("hi")).filter("lo != hi")
    s = s.join(per.select("contact", "session_no"), ["contact", "session_no"], "left_semi")
    role = F.when(~said, "system").when(F.col("who").eqNullSafe(F.col("owner")), "owner").otherwise("other")
    # seq runs 1, 2, 3 in a usable contact, and time with it: a session is a run of seq
    out = number_rows(s, ["contact", "session_no"], F.floor(F.col("seq") / SLICE), ["seq"], "place")
    return out.select("contact", "session_no", "place", "message_id", "seq", "t", "who", role.alias("role"))


def drop_reasons(contacts: DataFrame, messages: DataFrame, gap: int | None = None) -> DataFrame:
    """contact, reason of the contacts to drop: empty, broken or no_reply, the first that holds.

    Sessions carry who spoke; a contact has replies if its sessions together have two senders.
    Rows without a readable time are in no session, so their senders are added directly.
    """
    return _reasons(contacts, cut(distinct_messages(messages).drop("message_id", "source_zip")), gap)


def _reasons(contacts: DataFrame, rows: DataFrame, gap: int | None) -> DataFrame:
    said = _said()
    ends = (F.min(F.when(said, F.col("who"))).alias("lo"), F.max(F.when(said, F.col("who"))).alias("hi"))
    per_session = sessions(rows, gap).groupBy("contact", "session_no").agg(*ends).select("contact", "lo", "hi")
    timeless = rows.filter("t is null").groupBy("contact").agg(*ends)
    spoke = per_session.unionByName(timeless).groupBy("contact").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_contacts = contacts.select("contact").filter("contact is not null").distinct()
    reason = F.when(F.col("lo").isNull(), "empty").when(F.coalesce("broken", F.lit(False)), "broken").when(F.col("lo") == F.col("hi"), "no_reply")
    return all_contacts.join(spoke, "contact", "left").join(order_faults(rows), "contact", "left").select("contact", reason.alias("reason")).filter("reason is not null")
