"""The scope in which two rows of different exports can be one message: chat, sender, minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import sender_key
from chatloom.operators.timestamps import normalize_timestamps
from chatloom.session import small


def with_scope(rows: DataFrame, parsed: DataFrame | None, archives: DataFrame, options: DataFrame, extra: tuple[str, ...] = (), orders: DataFrame | None = None) -> DataFrame:
    """rows (some rows and columns of parsed) plus contact, who, minute, scope (32 hex digits of the three) and the archive columns ``extra``.

    The order of slash dates comes from the votes of ``parsed``, or from ``orders`` (slash_orders)
    where it is kept already. Rows without export, readable time or sender have a null scope. Filter
    on it only after the result is cut: a filter on computed columns would be pushed below them and
    evaluate the whole timestamp cascade again. Repeated archive rows count as one (the smallest
    contact name).
    """
    arch = archives.filter("source_zip is not null").groupBy("source_zip").agg(F.min_by(F.struct("contact_name", *extra), "contact_name").alias("a"))
    arch = small(arch.select("source_zip", F.col("a.contact_name").alias("contact"), *[F.col(f"a.{x}") for x in extra]))
    rows = normalize_timestamps(rows, options, evidence=parsed, orders=orders).withColumn("who", sender_key(F.col("sender")))
    rows = rows.withColumn("minute", F.floor(F.col("utc_sec") / 60)).join(arch, "source_zip", "left")
    key = F.concat("contact", F.lit("\0"), "who", F.lit("\0"), F.col("minute").cast("string"))
    return rows.withColumn("scope", F.substring(F.sha2(key, 256), 1, 32))
