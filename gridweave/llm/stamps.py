"""Mixed time stamps as text to instants.

A stamp, stripped of spaces and of 0x09 to 0x0D at both ends, is ten digits (seconds since 1970), thirteen
(milliseconds), or a date in one of six layouts, with or without a time and an offset from UTC (LAYOUTS,
CLOCK). Dates and times are parsed by a cascade of try_to_timestamp, each step guarded by the pattern of
its layout, so an impossible date or time is null and raises nothing.

Slashed dates are read day first and month first. One that is possible in a single order is that, and
votes for the order in its source; where both orders give different dates, the order with more votes
decides (rule votes), month first without a majority (rule default). Rows without source are one source.
Only these undecided rows are joined with the votes.

Dates without an offset are in the row's zone. The offset of a (zone, wall minute) is resolved once for all rows that
have it, and joined. Wall times that a zone skips or repeats take the offset before the change and are
ambiguous, as are dates that votes or the default decide. Offsets are taken to change once a day at most.

Null and unknown stamps are bad: they have no instant and don't vote. A stamp without offset whose zone is null
or not the name of a zone is bad too. Rows stay one for one, repeated ones and those without id too. Texts
of any length are looked at whole. Other columns are not read, whatever their names. An empty table gives
no rows. The result doesn't depend on the session's time zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stored

YEAR = "20[0-9]{2}"
TWO = "[0-9]{2}"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: Pattern of a date, how many characters it has, and how it is parsed.
LAYOUTS = [
    (f"{YEAR}-{TWO}-{TWO}", 10, "yyyy-MM-dd"),
    (f"{YEAR}{TWO}{TWO}", 8, "yyyyMMdd"),
    (f"{TWO}[.]{TWO}[.]{YEAR}", 10, "dd.MM.yyyy"),
    (f"{TWO} (?:{MONTHS}) {YEAR}", 11, "dd MMM yyyy"),
]
SLASHED = (f"{TWO}/{TWO}/{YEAR}", 10)
DAY_FIRST, MONTH_FIRST = "dd/MM/yyyy", "MM/dd/yyyy"
#: Hours and minutes, seconds, half of the day, offset.
CLOCK = f"[T ]({TWO}:{TWO})(:{TWO})?(?: ?([AP]M))?(?: ?(Z|[+-]{TWO}:?{TWO}))?"
SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000


def parsed(text: Column, pattern: str) -> Column:
    """Microseconds of a text read as UTC; null where it is null or impossible. An offset in the text keeps the session's zone out."""
    return F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{pattern} XXX")))


def offset(text: Column) -> Column:
    """Microseconds of Z, +hh:mm or -hhmm; null beyond 14:59."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).cast("long"), F.substring(digits, 3, 2).cast("long")
    value = (hours * 60 + minutes) * MINUTE * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    return F.when(text == "Z", F.lit(0).cast("long")).when((hours <= 14) & (minutes <= 59), value)


def instant(zone: Column, minute: Column) -> Column:
    """Microseconds of a wall minute in a zone, at the offset before a change where the zone skips or repeats it; null for an unknown zone."""
    wall = (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(mins=minute)).cast("string")
    return F.unix_micros(F.try_to_timestamp(F.concat(wall, F.lit(" "), zone), F.lit("yyyy-MM-dd HH:mm:ss VV")))


def read_stamps(stamps: DataFrame) -> DataFrame:
    """stamp_id, source, zone, epoch_us, offset_us, and wall times: wall_us of plain dates, day_us and month_us of slashed ones that are possible in that order.

    Bad stamps have none of them. offset_us is null where the zone tells.
    """
    raw = F.regexp_replace("raw", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    rows = stamps.select("stamp_id", "source", "zone", raw.alias("t"))
    fits = lambda pattern: F.col("t").rlike(rf"^(?:{pattern})\z")
    layout = reduce(lambda otherwise, k: F.when(fits(f"{k[1]}(?:{CLOCK})?"), k[0]).otherwise(otherwise), [(-1, SLASHED[0]), *((k, p) for k, (p, _, _) in enumerate(LAYOUTS))], F.lit(None).cast("int"))
    rows = rows.withColumn("layout", layout)
    length = reduce(lambda otherwise, k: F.when(F.col("layout") == k[0], k[1]).otherwise(otherwise), [(k, n) for k, (_, n, _) in enumerate(LAYOUTS)], F.lit(SLASHED[1]))
    dated = F.col("layout").isNotNull()
    rows = rows.withColumns({"date": F.when(dated, F.expr("t").substr(F.lit(1), length)), "rest": F.when(dated, F.expr("t").substr(length + 1, F.length("t")))})
    part = lambda k: F.nullif(F.regexp_extract("rest", rf"^{CLOCK}\z", k), F.lit(""))
    rows = rows.withColumns({"minutes": part(1), "seconds": F.coalesce(part(2), F.lit(":00")), "half": part(3), "shift": part(4)})
    time = F.concat("minutes", "seconds")
    clock = F.coalesce(
        F.when(F.col("rest") == "", F.lit(0).cast("long")),
        F.when(F.col("half").isNull(), parsed(F.concat(F.lit("1970-01-01 "), time), "yyyy-MM-dd HH:mm:ss")),
        F.when(F.col("half").isNotNull(), parsed(F.concat(F.lit("1970-01-01 "), time, F.lit(" "), F.col("half")), "yyyy-MM-dd hh:mm:ss a")),
    )
    date = F.coalesce(*[F.when(F.col("layout") == k, parsed(F.concat("date", F.lit(" 00:00")), f"{pattern} HH:mm")) for k, (_, _, pattern) in enumerate(LAYOUTS)])
    # a month above twelve isn't worth a try
    month_at = lambda at: F.substring("date", at, 2) <= "12"
    slashed = lambda at, pattern: F.when((F.col("layout") == -1) & month_at(at), parsed(F.concat("date", F.lit(" 00:00")), f"{pattern} HH:mm"))
    rows = rows.withColumns({"clock": clock, "shift_us": offset(F.col("shift")), "known": instant(F.col("zone"), F.lit(0)).isNotNull()})
    sound = F.col("clock").isNotNull() & F.when(F.col("shift").isNull(), F.col("known")).otherwise(F.col("shift_us").isNotNull())
    wall = lambda day: F.when(sound, day + F.col("clock"))
    epoch = F.when(fits("[0-9]{10}"), F.col("t").cast("long") * SECOND).when(fits("[0-9]{13}"), F.col("t").cast("long") * 1000)
    return rows.select(
        "stamp_id", "source", "zone", epoch.alias("epoch_us"), F.col("shift_us").alias("offset_us"),
        wall(date).alias("wall_us"), wall(slashed(4, DAY_FIRST)).alias("day_us"), wall(slashed(1, MONTH_FIRST)).alias("month_us"),
    )


def undecided() -> Column:
    return F.col("day_us").isNotNull() & F.col("month_us").isNotNull() & (F.col("day_us") != F.col("month_us"))


def votes(rows: DataFrame) -> DataFrame:
    """(vote_source, day_votes, month_votes): how many slashed dates of a source are possible in one order only."""
    single = rows.where(F.col("day_us").isNull() != F.col("month_us").isNull())
    return single.groupBy(F.col("source").alias("vote_source")).agg(F.count("day_us").alias("day_votes"), F.count("month_us").alias("month_votes"))


def decide(rows: DataFrame, majority: int = 1) -> DataFrame:
    """Adds wall_us to undecided rows, and rule: bad, epoch, votes, default or plain. An order wins with more than ``majority`` times the other's votes."""
    wall = F.coalesce("wall_us", "day_us", "month_us")
    rule = F.when(F.col("epoch_us").isNotNull(), "epoch").when(wall.isNotNull(), "plain").otherwise("bad")
    plain = rows.where(~undecided()).withColumns({"wall_us": wall, "rule": rule})
    open_ = rows.where(undecided()).join(votes(rows), F.col("source").eqNullSafe(F.col("vote_source")), "left")
    for_day = F.coalesce(F.col("day_votes") > F.col("month_votes") * majority, F.lit(False))
    for_month = F.coalesce(F.col("month_votes") > F.col("day_votes") * majority, F.lit(False))
    voted = open_.withColumns({"wall_us": F.when(for_day, F.col("day_us")).otherwise(F.col("month_us")), "rule": F.when(for_day | for_month, "votes").otherwise("default")})
    keep = ["stamp_id", "zone", "epoch_us", "offset_us", "wall_us", "rule"]
    return plain.select(*keep).unionByName(voted.select(*keep))


def offsets(rows: DataFrame) -> DataFrame:
    """(at_zone, at_minute, zone_us, changing) of all different wall minutes of a zone that a row without offset may stand for.

    A day before and a day after tell the offsets about a change: a skipped minute gives the same instant as
    the one later by the gap, a repeated one lies before the change while the one later by the overlap doesn't.
    """
    each = F.explode(F.array_compact(F.array("wall_us", "day_us", "month_us"))).alias("us")
    minutes = rows.where("offset_us is null and zone is not null").select(F.col("zone").alias("at_zone"), each).select("at_zone", F.floor(F.col("us") / MINUTE).alias("at_minute")).distinct()
    at = lambda minute: instant(F.col("at_zone"), minute)
    own = lambda shift: (F.col("at_minute") + shift) * MINUTE - at(F.col("at_minute") + shift)
    around = minutes.withColumns({"zone_us": own(0), "before": own(-DAY // MINUTE), "after": own(DAY // MINUTE)})
    jump = F.abs(F.col("after") - F.col("before"))
    later = around.withColumn("later", F.when(jump != 0, at(F.col("at_minute") + F.floor(jump / MINUTE))))
    wall = F.col("at_minute") * MINUTE
    skipped = (F.col("after") > F.col("before")) & (F.col("later") == wall - F.col("zone_us"))
    repeated = (F.col("after") < F.col("before")) & (F.col("later") == wall + jump - F.col("after"))
    changing = F.coalesce((jump != 0) & (F.col("zone_us") == F.col("before")) & (skipped | repeated), F.lit(False))
    return later.select("at_zone", "at_minute", "zone_us", changing.alias("changing"))


def normalise(stamps: DataFrame, majority: int = 1) -> DataFrame:
    """stamp_id, utc_us, rule and ambiguous of every row of stamps (stamp_id, source, zone, raw)."""
    rows = stored(read_stamps(stamps), "stamps")
    decided = decide(rows, majority).withColumn("by_choice", F.col("rule").isin("votes", "default"))
    zoned = F.col("wall_us").isNotNull() & F.col("offset_us").isNull()
    direct = decided.where(~zoned).select("stamp_id", F.coalesce("epoch_us", F.col("wall_us") - F.col("offset_us")).alias("utc_us"), "rule", F.col("by_choice").alias("ambiguous"))
    met = decided.where(zoned).join(offsets(rows), (F.col("zone") == F.col("at_zone")) & (F.floor(F.col("wall_us") / MINUTE) == F.col("at_minute")))
    return direct.unionByName(met.select("stamp_id", (F.col("wall_us") - F.col("zone_us")).alias("utc_us"), "rule", (F.col("by_choice") | F.col("changing")).alias("ambiguous")))
