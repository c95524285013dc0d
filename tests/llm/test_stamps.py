import re
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import functions as F

from gridweave.llm import stamps

SCHEMA = "stamp_id long, source string, zone string, raw string"
MONTHS = {m: k for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
DATE = r"(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)\.(\d\d)\.(20\d\d)|(\d\d) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20\d\d)|(\d\d)/(\d\d)/(20\d\d))"
STAMP = re.compile(DATE + r"(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP]M))?(?: ?(Z|[+-]\d\d:?\d\d))?)?", re.ASCII)


def plain(rows):
    """The contract, row by row."""

    def date(y, m, d):
        try:
            return datetime(int(y), int(m), int(d))
        except ValueError:
            return None

    read, votes = [], {}
    for key, source, zone, raw in rows:
        t = (raw or "").strip(" \t\n\v\f\r")
        epoch = int(t) * (1_000_000 if len(t) == 10 else 1000) if re.fullmatch(r"[0-9]{10}|[0-9]{13}", t) else None
        m, dates, shift, clock = STAMP.fullmatch(t), [], None, None
        if m:
            g = m.groups()
            h, mi, s = int(g[15] or 0), int(g[16] or 0), int(g[17] or 0)
            if g[18]:
                h = h % 12 + 12 * (g[18] == "PM") if 1 <= h <= 12 else 99
            clock = timedelta(hours=h, minutes=mi, seconds=s) if h < 24 and mi < 60 and s < 60 else None
            if g[19] == "Z":
                shift = 0
            elif g[19]:
                hh, mm = int(g[19][1:3]), int(g[19][-2:])
                shift = (hh * 60 + mm) * (-60 if g[19][0] == "-" else 60) if hh <= 14 and mm < 60 else None
                clock = None if shift is None else clock
            if not g[19] and zone not in available_timezones():
                clock = None
            if g[12]:
                dates = [date(g[14], g[13], g[12]), date(g[14], g[12], g[13])]
            else:
                dates = [date(g[0] or g[3] or g[8] or g[11], MONTHS.get(g[10]) or g[1] or g[4] or g[7], g[2] or g[5] or g[6] or g[9])]
            dates = [d + clock if d and clock is not None else None for d in dates]
            if len(dates) == 2 and (dates[0] is None) != (dates[1] is None):
                votes.setdefault(source, [0, 0])[dates[0] is None] += 1
        read.append((key, source, zone, epoch, dates, shift if m else None))
    out = []
    for key, source, zone, epoch, dates, shift in read:
        possible = [d for d in dates if d]
        if epoch is not None:
            out.append((key, epoch, "epoch", False))
        elif not possible:
            out.append((key, None, "bad", False))
        else:
            rule, wall = "plain", possible[0]
            if len(possible) == 2 and possible[0] != possible[1]:
                a, b = votes.get(source, (0, 0))
                rule, wall = ("votes" if a != b else "default"), possible[0 if a > b else 1]
            changing = False
            if shift is None:
                here = [wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1)]
                changing = here[0].utcoffset() != here[1].utcoffset()
                at = here[0]
            else:
                at = wall.replace(tzinfo=timezone(timedelta(seconds=shift)))
            us = (at.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
            out.append((key, us, rule, rule != "plain" or changing))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in df.collect()), key=str)


CASES = [
    *("1700000000", "1700000000123", "170000000", "١٧٠٠٠٠٠٠٠٠", "2024-02-29", "2023-02-29", "20240229", "20240230T10:00", "31.04.2024", "30.04.2024 23:59:59", "07 Apr 2024 13:45", "07 apr 2024 13:45"),
    *("07 Apr 2024 13:45 PM", "07 Apr 2024 12:45 AM", "07 Apr 2024 12:45PM", "07 Apr 2024 00:45 AM", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "1999-01-01", "2024-1-1", "2024-01-01T"),
    *("2024-01-01T10:00Z", "2024-01-01 10:00 Z", "2024-01-01 10:00:00 +14:59", "2024-01-01 10:00+15:00", "2024-01-01 10:00-0060", "2024-01-01 10:00-0959", "2024-01-01 10:00 PM -05:30", "2024-01-01  10:00", "2024-01-01\n", "\t2024-01-01 \r\n"),
    *("2024-01-01 ", " 2024-01-01", "13/01/2024", "01/13/2024", "13/13/2024", "03/03/2024", "04/05/2024", "04/05/2024 25:00", "31/04/2024", "29/02/2023", "02/29/2024 10:00 +02:00", "05/06/2024 10:00 -0300"),
    *("2024-03-31 02:30", "2024-10-27 02:30", "2024-10-27 03:00", "2024-10-27 01:59:59", "2024-03-31 03:00", "2024-03-10 02:15 AM", "2024-11-03 01:15", "2011-12-30 10:00", "2024-04-07 01:45", "", " ", None, "x" * 100_000, "n/a"),
]


def test_against_the_contract_row_by_row(spark):
    zones = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Pacific/Apia", "Australia/Lord_Howe", None, "Nowhere/None"]
    sources = ["a", "b", "c", None]
    rows = [(k * 100 + z * 10 + s, source, zone, raw) for k, raw in enumerate(CASES) for z, zone in enumerate(zones) for s, source in enumerate(sources)]
    rows += [(-k, "a", "UTC", "25/12/2024") for k in range(3)] + [(-9, "b", "UTC", "12/25/2024"), (-8, None, "UTC", "12/25/2024"), (-8, None, "UTC", "12/25/2024"), (None, "d", "Europe/Berlin", "01/02/2024")]
    assert result(stamps.normalise(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_every_minute_about_a_change(spark):
    rows, at = [], {"Europe/Berlin": ["2024-03-31", "2024-10-27"], "Australia/Lord_Howe": ["2024-04-07", "2024-10-06"], "America/New_York": ["2024-03-10", "2024-11-03"], "Pacific/Apia": ["2011-12-30"], "Africa/Casablanca": ["2024-03-10", "2024-04-14"]}
    for zone, days in at.items():
        rows += [(len(rows) + k, "s", zone, f"{day} {k // 60:02}:{k % 60:02}") for day in days for k in range(0, 1440, 7)]
    assert result(stamps.normalise(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_session_zone_other_columns_and_empty(spark):
    rows = [(1, "s", "Europe/Berlin", "2024-03-31 02:30"), (2, "s", "UTC", "04/05/2024")]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("?") for c in ("t", "date", "rest", "layout", "rule", "utc_us", "ambiguous", "known", "wall_us", "vote_source", "at_zone")})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert result(stamps.normalise(clashing)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert result(stamps.normalise(df.limit(0))) == []
    assert stamps.normalise(df.limit(0)).columns == ["stamp_id", "utc_us", "rule", "ambiguous"]


def test_majority(spark):
    rows = [(1, "s", "UTC", "25/12/2024"), (2, "s", "UTC", "25/12/2024"), (3, "s", "UTC", "12/25/2024"), (4, "s", "UTC", "04/05/2024")]
    df = spark.createDataFrame(rows, SCHEMA)
    of = lambda majority: {r.stamp_id: r.rule for r in stamps.normalise(df, majority).collect()}[4]
    assert (of(1), of(2)) == ("votes", "default")
