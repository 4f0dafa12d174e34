import datetime as dt
import zoneinfo

from chatloom.operators.timestamps import normalize_timestamps

P = "row_id long, source_zip string, timestamp string"
O = "source_zip string, date_format string, timezone string"  # noqa: E741


def run(spark, rows, opts, **kw):
    df = normalize_timestamps(spark.createDataFrame(rows, P), spark.createDataFrame(opts, O), **kw)
    return {r["row_id"]: r["utc_sec"] for r in df.collect()}


def sec(*a, tz="UTC", fold=0):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz), fold=fold).timestamp())


def test_forms(spark):
    rows = [
        (1, "a", "2024-03-05T10:11:12"), (2, "a", "2024-03-05T10:11:12.987Z"), (3, "a", "2024-03-05T10:11:12-03:00"), (4, "a", "20240305T101112Z"),
        (5, "a", "1709633472"), (6, "a", "1709633472999"), (7, "a", "5.3.2024 10:11"), (8, "a", "5 de mar. de 2024 10:11"), (9, "a", "Mar 5, 2024, 1:52 PM"),
        (10, "a", "5/3/24, 12:05 am"), (11, "a", "2024/03/05 10:11"), (12, "a", "2024-03-05 10:11:12 EST"), (13, "a", "‎[05/03/2024, 10:11:12]"),
    ]
    got = run(spark, rows, [("a", "DD/MM", "UTC")])
    base = sec(2024, 3, 5, 10, 11, 12)
    assert got == {
        1: base, 2: base, 3: base + 3 * 3600, 4: base, 5: 1709633472, 6: 1709633472, 7: base - 12, 8: base - 12, 9: sec(2024, 3, 5, 13, 52),
        10: sec(2024, 3, 5, 0, 5), 11: base - 12, 12: base + 5 * 3600, 13: base,
    }


def test_unreadable_is_null(spark):
    bad = [None, "", "--:--", "hora inválida", "2025-13-01 09:00:00", "2026-02-30T10:00:00", "99/99/2026, 10:00", "13:00 PM", "1/1/24, 13:05 PM", "2024-01-01T24:00:00", "x" * 100_000]
    assert set(run(spark, [(i, "a", t) for i, t in enumerate(bad)], [("a", None, None)]).values()) == {None}


def test_daylight_saving(spark):
    z = "America/New_York"
    rows = [(1, "a", "2024-11-03T01:30:00"), (2, "a", "2024-03-10T02:30:00"), (3, "a", "2024-11-03 01:30:00 EST"), (4, "a", "2024-11-03 01:30:00 EDT")]
    got = run(spark, rows, [("a", None, z)])
    assert got[1] == got[4] == sec(2024, 11, 3, 1, 30, tz=z) and got[3] == got[1] + 3600
    assert got[2] == sec(2024, 3, 10, 7, 30)  # 02:30 with the offset before the change


def test_zones_and_defaults(spark):
    rows = [(i, k, "2024-03-05T10:00:00") for i, k in enumerate(["utc", "plus", "none", "bad", "gone", None])]
    got = run(spark, rows, [("utc", None, "UTC"), ("plus", None, "UTC+5:30"), ("none", None, None), ("bad", None, "Mars/Base"), ("utc", None, "UTC")])
    b = sec(2024, 3, 5, 10)
    assert got == {0: b, 1: b - 19800, 2: b + 10800, 3: None, 4: b + 10800, 5: b + 10800}


def test_order_by_votes(spark):
    rows = [(1, "us", "3/25/24, 10:00"), (2, "us", "4/5/24, 10:00"), (3, "br", "25/3/24, 10:00"), (4, "br", "5/4/24, 10:00"), (5, "?", "5/4/24, 10:00"), (6, "fix", "25/3/24, 10:00")]
    got = run(spark, rows, [("us", None, "UTC"), ("br", None, "UTC"), ("?", None, "UTC"), ("fix", "MM/DD", "UTC")])
    d = sec(2024, 4, 5, 10)
    assert got[2] == d and got[4] == d and got[5] == d and got[6] is None


def test_votes_of_a_whole_table(spark):
    whole = [(1, "us", "3/25/24, 10:00"), (2, "us", "4/5/24, 10:00")]
    part = normalize_timestamps(spark.createDataFrame(whole[1:], P), spark.createDataFrame([("us", None, "UTC")], O), evidence=spark.createDataFrame(whole, P))
    assert part.first()["utc_sec"] == sec(2024, 4, 5, 10)


def test_empty_repeated_and_clashing(spark):
    assert run(spark, [], []) == {}
    df = spark.createDataFrame([(1, "a", "2024-03-05T10:00:00", 7, "x")] * 2, P + ", utc_sec int, __ts_t string")
    out = normalize_timestamps(df, spark.createDataFrame([("a", "DD/MM", "UTC"), ("a", "DD/MM", "UTC")], O))
    assert [r["utc_sec"] for r in out.collect()] == [sec(2024, 3, 5, 10)] * 2 and "__ts_t" in out.columns
