"""Mixed timestamp formats and zones into UTC seconds (problem 7).

An ordered cascade of anchored patterns reads the text. The first pattern that matches decides
the form; its fields must then be a possible date and time. What the text says of its zone
(offset, Z, abbreviation, epoch) wins; else the export's zone; else a default zone. All of it is
one projection plus one small aggregate per export, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import INVISIBLE, WS, is_ascii
from chatloom.session import apart, cut, small

DEFAULT_ZONE = "America/Sao_Paulo"
DEFAULT_ORDER = "DD/MM"

# Month names of the export languages, first three letters without accents.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "apr": 4, "abr": 4, "may": 5, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "ago": 8, "sep": 9, "set": 9, "oct": 10, "out": 10, "nov": 11, "dec": 12, "dez": 12, "dic": 12,
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "BRST": -120, "ART": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?"
_AP = r"(?:[   ]?([AaPp])\.?[   ]?[Mm]\.?)?"
_Z = r"(?:[  ]?(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}))?"
#: Anchored patterns in the order tried: name, pattern, where groups 1.. go.
PATTERNS = (
    ("epoch_s", r"^(\d{9,10})\z", "e"),
    ("epoch_ms", r"^(\d{13})\z", "e"),
    ("epoch_us", r"^(\d{16})\z", "e"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?\z", "ymdHMSz"),
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|,? ){_T}{_AP}{_Z}\z", "ymdHMSpz"),
    ("slash_year", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}),? {_T}{_AP}{_Z}\z", "ymdHMSpz"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_T}{_AP}{_Z}\z", "dmyHMSpz"),
    ("slash", rf"^\[?(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? {_T}{_AP}{_Z}\]?\z", "abyHMSpz"),
    ("day_name", rf"^(\d{{1,2}})(?: de)? ([A-Za-zç]{{3,10}})\.?,?(?: de)? (\d{{4}}),? {_T}{_AP}{_Z}\z", "dnyHMSpz"),
    ("name_day", rf"^([A-Za-z]{{3,10}})\.? (\d{{1,2}}),? (\d{{4}}),? {_T}{_AP}{_Z}\z", "ndyHMSpz"),
)


def valid_zones(spark: SparkSession) -> list[str]:
    """Zone names that both Java and the driver know; about 600, a fixed size."""
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def _zone(c: Column, zones: list[str], default: str) -> Column:
    """The zone name if it is known or a fixed offset; null becomes the default, anything else null."""
    t = F.trim(c)
    fixed = t.rlike(r"^(?:UTC|GMT|UT)?[+-]\d{1,2}(?::\d{1,2})?\z")
    h = F.abs(F.regexp_extract(t, r"[+-](\d{1,2})", 1).try_cast("int"))
    return F.when(c.isNull() | (t == ""), F.lit(default)).when(t.isin(zones) | (fixed & (h <= 14)), t)


#: Places in the canonical array: form, then the roles of a pattern's groups.
ROLES = "eymdnabHMSpz"


def _fields(ts: Column) -> Column:
    """Array [form, *ROLES] of the first pattern that matches, null if none does.

    Each branch is one regexp_replace into a fixed layout, which keeps the generated code short.
    """
    out = F.lit(None).cast("string")
    for name, pattern, roles in reversed(PATTERNS):
        layout = "|".join([name, *(f"${roles.index(r) + 1}" if r in roles else "" for r in ROLES)])
        out = F.when(_may(name, ts) & ts.rlike(pattern), F.regexp_replace(ts, pattern, layout)).otherwise(out)
    return F.split(out, r"\|")


def _may(name: str, ts: Column) -> Column:
    """A cheap test every text of the form passes, before its pattern is tried."""
    if name.startswith("epoch"):
        return F.length(ts) <= 16
    mark = {"slash": "/", "slash_year": "/", "dots": ".", "iso": "-"}.get(name)
    return ts.contains(mark) if mark else F.lit(True)


def _clean(ts: Column) -> Column:
    """The text without invisible marks and outer white space."""
    wide = F.regexp_replace(F.regexp_replace(ts, f"[{INVISIBLE}]", ""), rf"^[{WS}]+|[{WS}]+\z", "")
    return F.when(is_ascii(ts), F.btrim(ts, F.lit(" \t\n\x0b\f\r"))).otherwise(wide)


def _zone_abbreviations(spark: SparkSession, zones: list[str]) -> dict[str, int]:
    """"zone ABBR" -> minutes, where a zone's own short name has another offset than ABBREVIATIONS says."""
    tz, out = spark.sparkContext._jvm.java.util.TimeZone, {}
    for name in zones:
        if "/" not in name or name.startswith(("Etc/", "SystemV/")):
            continue
        z = tz.getTimeZone(name)
        base = z.getRawOffset() // 60000
        for summer in (False, True) if z.useDaylightTime() else (False,):
            short = z.getDisplayName(summer, 0)
            minutes = base + (z.getDSTSavings() // 60000 if summer else 0)
            if ABBREVIATIONS.get(short, minutes) != minutes:
                out[f"{name} {short}"] = minutes
    return out


def slash_orders(rows: DataFrame, key: str = "source_zip", ts: str = "timestamp") -> DataFrame:
    """key, dm, md: whether every readable slash date of a key is a date day first, month first.

    Keys without a slash date are left out. Tables of several parts of a key combine by bool_and.
    """
    pattern, layout = next((x, "$1|$2|$3") for n, x, _ in PATTERNS if n == "slash")
    t = _clean(F.col(ts))
    dated = rows.filter(F.contains(ts, F.lit("/"))).select(F.col(key), t.alias("t"))
    # null where the pattern doesn't match: casts may be evaluated before any filter
    p = dated.select(key, F.split(F.when(F.col("t").rlike(pattern), F.regexp_replace("t", pattern, layout)), r"\|").alias("p"))
    at = lambda i: F.get("p", F.lit(i)).cast("int")
    p = apart(p.select(key, at(0).alias("a"), at(1).alias("b"), F.when(F.length(F.get("p", F.lit(2))) <= 2, at(2) + 2000).otherwise(at(2)).alias("y")))
    p = apart(p.select(key, _possible(F.col("y"), F.col("b"), F.col("a")).alias("dm"), _possible(F.col("y"), F.col("a"), F.col("b")).alias("md")))
    one = lambda c: F.bool_and(F.when(F.col("dm") | F.col("md"), F.col(c))).alias(c)
    return p.groupBy(key).agg(one("dm"), one("md")).filter("dm is not null")


def _possible(y: Column, m: Column, d: Column) -> Column:
    """A date of the calendar, by month length and leap years."""
    last = F.when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def _int(c: Column) -> Column:
    """A group of digits as an int, null if empty. (try_cast costs an exception per empty group.)"""
    return F.when(c != "", c.cast("int"))


def _offset_minutes(z: Column, zone: Column, own: dict[str, int]) -> Column:
    """Minutes of an offset or abbreviation (in ``zone`` first); null if there is none or it is unknown."""
    num = z.rlike(r"^[+-]\d{2}:?\d{2}\z")
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, -2, 2).try_cast("int")
    minutes = F.when((h <= 14) & (m < 60), F.when(z.startswith("-"), -(h * 60 + m)).otherwise(h * 60 + m))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    of_zone = F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.concat_ws(" ", zone, z)) if own else F.lit(None)
    return F.when(num, minutes).otherwise(F.coalesce(of_zone, F.try_element_at(table, z)))


def normalize_timestamps(
    df: DataFrame,
    options: DataFrame,
    *,
    evidence: DataFrame | None = None,
    orders: DataFrame | None = None,
    key: str = "source_zip",
    ts: str = "timestamp",
    default_zone: str = DEFAULT_ZONE,
    default_order: str = DEFAULT_ORDER,
    out: str = "utc_sec",
) -> DataFrame:
    """df with a BIGINT column ``out``: Unix seconds of ``ts``, rounded down, null if unreadable.

    options has ``key``, ``date_format`` and ``timezone``; keys without a row get the defaults.
    Repeated option rows of one key count as one (the smallest). Local times: a repeated hour is
    the earlier instant, a skipped hour is read with the offset before the change. Slash dates
    follow ``date_format``; where that is null, the order under which every readable slash date of
    the key is valid, or ``default_order`` if both orders are. ``evidence`` has the rows that vote on
    the order (df itself if None): pass the whole table when df is a part of it; ``orders`` gives the
    result of that vote (slash_orders) where it is known already. An abbreviation is read as the
    export's own zone uses it, else by ABBREVIATIONS. A null or empty text is unreadable; a null key
    is one export without options. Rows and all other columns stay; a column that is already called
    ``out`` is replaced. The side table of keys is cut and broadcast where it is small.
    """
    p = "__ts_"
    while any(c.startswith(p) for c in [*df.columns, *(evidence.columns if evidence is not None else [])]):
        p += "_"
    votes = slash_orders(df if evidence is None else evidence, key, ts) if orders is None else orders
    votes = votes.select(F.col(key).alias(f"{p}k"), F.col("dm").alias(f"{p}dm"), F.col("md").alias(f"{p}md"))
    df = df.withColumn(f"{p}t", _clean(F.col(ts))).withColumn(f"{p}f", _fields(F.col(f"{p}t")))
    df = apart(df)
    f = lambda name: F.col(f"{p}f")[0 if name == "form" else ROLES.index(name) + 1]
    zones = valid_zones(df.sparkSession)

    a, b, year = _int(f("a")), _int(f("b")), _int(f("y"))
    year = F.when(F.length(f("y")) <= 2, year + 2000).otherwise(year)
    slash = f("form") == "slash"
    opts = (
        options.groupBy(F.col(key).alias(f"{p}k"))
        .agg(F.min(F.struct("date_format", "timezone")).alias("o"))
        .select(f"{p}k", F.col("o.date_format").alias(f"{p}df"), F.col("o.timezone").alias(f"{p}tz"))
    )
    side = opts.join(votes, f"{p}k", "full_outer").select(
        f"{p}k",
        F.coalesce(
            F.when(F.col(f"{p}df").isin("DD/MM", "MM/DD"), F.col(f"{p}df")),
            F.when(F.col(f"{p}dm") & ~F.col(f"{p}md"), F.lit("DD/MM")).when(F.col(f"{p}md") & ~F.col(f"{p}dm"), F.lit("MM/DD")),
            F.lit(default_order),
        ).alias(f"{p}order"),
        _zone(F.col(f"{p}tz"), zones, default_zone).alias(f"{p}zone"),
        F.lit(True).alias(f"{p}known"),
    )
    side = small(cut(side))
    df = df.join(side, df[key] == side[f"{p}k"], "left")

    day_first = F.coalesce(F.col(f"{p}order"), F.lit(default_order)) == "DD/MM"
    name = F.lower(F.translate(F.substring(f("n"), 1, 3), "çÇ", "cC"))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    half, hour = F.lower(f("p")), _int(f("H"))
    df = df.withColumns({
        f"{p}y": year,
        f"{p}m": F.when(slash, F.when(day_first, b).otherwise(a)).when(f("n") != "", F.try_element_at(months, name)).otherwise(_int(f("m"))),
        f"{p}d": F.when(slash, F.when(day_first, a).otherwise(b)).otherwise(_int(f("d"))),
        f"{p}hh": F.when(half == "", hour).when(hour.between(1, 12), (hour % 12) + F.when(half == "p", 12).otherwise(0)),
        f"{p}mm": _int(f("M")),
        f"{p}ss": F.coalesce(_int(f("S")), F.lit(0)),
    })
    y, m, d, hh, mm, ss = (F.col(f"{p}{x}") for x in ("y", "m", "d", "hh", "mm", "ss"))
    fits = _possible(y, m, d) & hh.between(0, 23) & mm.between(0, 59) & ss.between(0, 59)
    days = F.datediff(F.make_date(y, m, d), F.lit("1970-01-01").cast("date")).cast("bigint")
    df = df.withColumn(f"{p}local", F.when(fits, days * 86400 + hh * 3600 + mm * 60 + ss))
    df = apart(df)
    secs = F.col(f"{p}local")
    zone = F.when(F.col(f"{p}known"), F.col(f"{p}zone")).otherwise(F.lit(default_zone))
    by_zone = F.when(zone.isNotNull(), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(secs), zone)))
    e = F.when(f("e") != "", f("e").cast("bigint"))
    value = (
        F.when(f("form") == "epoch_s", e)
        .when(f("form") == "epoch_ms", (e - F.pmod(e, F.lit(1000))).cast("decimal(20,0)") / 1000)
        .when(f("form") == "epoch_us", (e - F.pmod(e, F.lit(1000000))).cast("decimal(20,0)") / 1000000)
        .when(f("z") != "", secs - _offset_minutes(f("z"), zone, _zone_abbreviations(df.sparkSession, zones)).cast("bigint") * 60)
        .otherwise(by_zone)
    ).cast("bigint")
    keep = [c for c in df.columns if not c.startswith(p) and c.lower() != out.lower()]
    return df.select(*keep, value.alias(out))
