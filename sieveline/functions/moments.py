"""Time stamps as their writers spelled them, compared no more closely than they allow.

A stamp is a struct of day (yyyyMMdd), clock (HHmmss or null) and offset (minutes east of UTC, or null where nobody
said one). It names an instant only if it has all three.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a day, a clock and a zone; the first one is that of PDF.
PDF_STAMP = r"^D:(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?"
DAY, CLOCK = r"^(\d{4})\D?(\d{2})\D?(\d{2})", r"[T ](\d{2}):?(\d{2}):?(\d{2})"
ZONE = r"(?:(Z)|([+-])(\d{2})'?:?(\d{2}))'?\s*$"
#: Months of 30.436875 days and years of twelve of them.
MONTH, YEAR = 30.436875, 365.2425


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(text: Column, pattern: str, groups: range) -> Column:
    return F.nullif(F.concat(*[F.coalesce(F.regexp_extract(text, pattern, i), F.lit("")) for i in groups]), F.lit(""))


def stamp(value: Column) -> Column:
    """STRUCT<day, clock, offset>, null if there is no day."""

    def read(text: Column) -> Column:
        pdf = text.rlike(PDF_STAMP)
        day = F.when(pdf, _joined(text, PDF_STAMP, range(1, 4))).otherwise(_joined(text, DAY, range(1, 4)))
        clock = F.when(pdf, _joined(text, PDF_STAMP, range(4, 7))).otherwise(_joined(text, CLOCK, range(1, 4)))
        minutes = F.regexp_extract(text, ZONE, 3).try_cast("int") * 60 + F.regexp_extract(text, ZONE, 4).try_cast("int")
        offset = F.when(F.regexp_extract(text, ZONE, 1) == "Z", 0).when(text.rlike(ZONE), F.when(F.regexp_extract(text, ZONE, 2) == "-", -minutes).otherwise(minutes))
        return F.struct(day.alias("day"), clock.alias("clock"), offset.cast("int").alias("offset"))

    return _let(_let(F.trim(value), read), lambda s: F.when(s["day"].isNotNull(), s))


def reading(s: Column) -> Column:
    """Day and clock of a stamp as if they were in UTC; null without a clock, and for days that don't exist."""
    return F.when(s["clock"].isNotNull(), F.try_to_timestamp(F.concat(s["day"], s["clock"]), F.lit("yyyyMMddHHmmss")))


def utc(s: Column) -> Column:
    """The instant of a stamp with clock and zone, else null."""
    return F.when(s["offset"].isNotNull(), reading(s) - F.make_dt_interval(mins=s["offset"]))


def _both(left: Column, right: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """body of two stamps and their instants, each computed once; null if one has no day."""
    pair = F.struct(stamp(left).alias("a"), stamp(right).alias("b"))
    four = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), utc(p["a"]).alias("x"), utc(p["b"]).alias("y"))
    return _let(_let(pair, four), lambda q: F.when(q["a"].isNotNull() & q["b"].isNotNull(), body(q["a"], q["b"], q["x"], q["y"])))


def instant(value: Column) -> Column:
    """The instant, or the mere reading where no zone is given; null without a time of day."""
    return _let(stamp(value), lambda s: F.coalesce(utc(s), reading(s)))


def after(left: Column, right: Column) -> Column:
    """Whether the first text names the later moment; null where the two can't be ranked."""

    def ranked(a: Column, b: Column, x: Column, y: Column) -> Column:
        by_reading = F.when(a["day"] != b["day"], a["day"] > b["day"]).when(a["clock"].isNotNull() & b["clock"].isNotNull(), a["clock"] > b["clock"])
        return F.when(x.isNotNull() & y.isNotNull(), x > y).when(a["offset"].eqNullSafe(b["offset"]), by_reading)

    return _both(left, right, ranked)


def same_moment(left: Column, right: Column) -> Column:
    """Whether both texts name one moment, as closely as both say; null if one can't be read."""
    return _both(left, right, lambda a, b, x, y: F.when(x.isNotNull() & y.isNotNull(), x == y).when(a["day"] != b["day"], False).otherwise(F.coalesce(a["clock"] == b["clock"], F.lit(True))))


def created_after(authored: Column, arrived: Column, minutes: int = 5) -> Column:
    """Whether a file says that it was made this much later than it arrived; texts that can't be read are compared as such."""
    pair = F.struct(instant(authored).alias("a"), instant(arrived).alias("b"))
    return _let(pair, lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), p["a"] > p["b"] + F.make_dt_interval(mins=F.lit(minutes))).otherwise(authored > arrived))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def apart(first: Column, second: Column) -> Column:
    """How far the second instant is from the first: `72 days earlier`; null for one instant."""
    seconds = F.timestamp_diff("SECOND", first, second)
    n, days = F.abs(seconds), F.abs(seconds) / 86400
    years = F.floor(days / YEAR)
    months = F.bround((days - years * YEAR) / MONTH).cast("long")
    years, months = F.when(months == 12, years + 1).otherwise(years), F.when(months == 12, 0).otherwise(months)
    round_ = lambda unit: F.bround(n / unit).cast("long")
    said = (
        F.when(n < 60, counted(n, "second")).when(n < 3600, counted(round_(60), "minute")).when(n < 86400, counted(round_(3600), "hour")).when(days < 365, counted(round_(86400), "day"))
        .otherwise(F.concat(counted(years, "year"), F.when(months > 0, F.concat(F.lit(" "), counted(months, "month"))).otherwise("")))
    )
    return F.when(n > 0, F.concat(said, F.when(seconds > 0, " later").otherwise(" earlier")))


def interval(one: Column, other: Column) -> Column:
    """The distance of two instants in the largest whole unit: `3 days`."""
    n = F.abs(F.timestamp_diff("SECOND", one, other))
    out = F.when(n.isNotNull(), F.lit("0 seconds"))
    for size, unit in ((1, "second"), (60, "minute"), (3600, "hour"), (86400, "day")):
        out = F.when(n >= size, counted(F.floor(n / size), unit)).otherwise(out)
    return out


def shown(value: Column) -> Column:
    """A stamp as a reader reads it, saying UTC only where its writer gave a zone; what can't be read stays."""
    said = lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(_let(stamp(value), lambda s: F.coalesce(F.concat(said(utc(s)), F.lit(" UTC")), said(reading(s)))), value)


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Seconds from 1970 back to the first day of other clocks.
EPOCHS = {"unix": 0, "mac": 978307200, "quicktime": -2082844800, "windows": -11644473600}


def from_epoch(n: Column, clock: str = "unix", per_second: int = 1) -> Column:
    """Timestamp of a count of seconds, or of parts of them, on one of the clocks of EPOCHS."""
    return F.timestamp_micros((F.floor(n.cast("decimal(38,0)") * 1000000 / per_second) + EPOCHS[clock] * 1000000).cast("long"))


def iso6709(text: Column) -> Column:
    """STRUCT<lat, lon> of a position like +52.2297+021.0122/, null if it is none."""
    part = lambda i: F.regexp_extract(text, r"^([+-]\d{1,2}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)", i).try_cast("double")
    return F.when(part(1).between(-90, 90) & part(2).between(-180, 180), F.struct(part(1).alias("lat"), part(2).alias("lon")))


def sexagesimal(degrees: Column, positive: str, negative: str) -> Column:
    """Degrees as 52°13'46.92\"N."""
    n = F.round(F.abs(degrees) * 360000).cast("long")
    return F.format_string("%d°%02d'%02d.%02d\"%s", F.floor(n / 360000), F.floor(n % 360000 / 6000), F.floor(n % 6000 / 100), n % 100, F.when(degrees < 0, negative).otherwise(positive))
