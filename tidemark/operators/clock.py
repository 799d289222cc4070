"""Sessions of an exchange in its own time zone, and when a bar of another market may be used.

A session table has one row a session: date, open_local and close_local, which are wall-clock times in the exchange's zone (timestamp_ntz);
half days have an earlier close. Instants are UTC without zone (timestamp_ntz), so that no result hangs on the session's zone; daylight
saving is resolved for each session by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_utc(local: Column, zone: str) -> Column:
    """The UTC instant of a wall-clock time of a zone. A time that daylight saving skips counts as moved ahead, one that it repeats as the earlier."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))


def from_utc(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def session_table(dates: DataFrame, zone: str, opens: str = "09:30", closes: str = "16:00", half_days: Column | None = None, half_close: str = "13:00", finalization: int = 1) -> DataFrame:
    """date, session (its number from 0), open_utc, close_utc, half_day and, ``finalization`` sessions on, final_date and final_close_utc.

    dates: one row a session. The last sessions have no final one yet: null."""
    half = F.lit(False) if half_days is None else F.coalesce(half_days, F.lit(False))
    at = lambda time: F.concat_ws(" ", F.col("date").cast("string"), time).cast("timestamp_ntz")
    w = Window.orderBy("date")  # one row a session
    s = dates.select(F.col("date").cast("date").alias("date"), half.alias("half_day")).distinct()
    s = s.withColumns({"open_utc": to_utc(at(F.lit(opens)), zone), "close_utc": to_utc(at(F.when(F.col("half_day"), half_close).otherwise(closes)), zone)})
    ahead = lambda c: F.lead(c, finalization).over(w) if finalization else F.col(c)
    return s.withColumns({"session": F.row_number().over(w) - 1, "final_date": ahead("date"), "final_close_utc": ahead("close_utc")})


def _minute(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def phased(bars: DataFrame, sessions: DataFrame, zone: str, at: str, business_date: str, interval: int, pre_from: int = 4 * 60, after_to: int = 20 * 60) -> DataFrame:
    """bars with open_utc and close_utc of their business date, ``phase`` and ``bucket`` of ``interval`` minutes.

    regular lies between open and close, both included; premarket from ``pre_from`` (minute of the local day) to the open; after_hours behind the
    close's minute to ``after_to``; all else, and what bears another day's date, is overnight. A bucket counts from the open, pre_from, the close or
    midnight. A business date that is no session has null phase; so has a bar that lies within another date's regular session (``conflict``)."""
    keyed = bars.withColumn("_local", from_utc(F.col(at), zone)).withColumn("_day", F.col("_local").cast("date"))
    own = sessions.select(F.col("date").alias(business_date), "open_utc", "close_utc")
    other = sessions.select(F.col("date").alias("_day"), F.col("open_utc").alias("_open"), F.col("close_utc").alias("_close"))
    j = keyed.join(F.broadcast(own), business_date, "left").join(F.broadcast(other), "_day", "left")  # one row a session
    utc, same = F.col(at).cast("timestamp_ntz"), F.col("_day") == F.col(business_date)
    conflict = F.coalesce(utc.between(F.col("_open"), F.col("_close")) & ~same, F.lit(False))
    minute, opened, closed = _minute(F.col("_local")), _minute(from_utc(F.col("open_utc"), zone)), _minute(from_utc(F.col("close_utc"), zone))
    phase = (
        F.when(F.col("open_utc").isNull() | conflict, None)
        .when(same & utc.between(F.col("open_utc"), F.col("close_utc")), "regular")
        .when(same & (minute >= pre_from) & (minute < opened), "premarket")
        .when(same & (minute > closed) & (minute < after_to), "after_hours")
        .otherwise("overnight")
    )
    since = lambda a: F.floor((F.unix_seconds(utc.cast("timestamp")) - F.unix_seconds(F.col(a).cast("timestamp"))) / 60)
    offset = F.when(F.col("phase") == "regular", since("open_utc")).when(F.col("phase") == "premarket", minute - pre_from).when(F.col("phase") == "after_hours", since("close_utc")).otherwise(minute)
    p = j.withColumns({"phase": phase, "conflict": conflict})
    return p.withColumn("bucket", F.when(F.col("phase").isNotNull(), F.concat(F.col("phase"), F.lit(":"), F.lpad(F.greatest(F.lit(0), F.floor(offset / interval)).cast("string"), 4, "0")))).drop("_local", "_day", "_open", "_close")


def bar_available(at: Column, interval_minutes: int, lag_seconds: int) -> Column:
    """A bar may be used when it has certainly closed, its time being taken for its start, and the vendor's lag is over."""
    return at.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(interval_minutes), secs=F.lit(lag_seconds))


def daily_available(bars: DataFrame, sessions: DataFrame, date: str, lag_seconds: int) -> DataFrame:
    """Daily bars with final_date and available_utc: the close of the session that makes them final, and the lag. Bars of no session, or of none that is final yet, have null."""
    s = F.broadcast(sessions.select(F.col("date").alias(date), "final_date", "final_close_utc"))  # one row a session
    return bars.join(s, date, "left").withColumn("available_utc", F.col("final_close_utc") + F.make_dt_interval(secs=F.lit(lag_seconds))).drop("final_close_utc")


def available(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Rows that may be used at a cutoff."""
    return rows.where(F.col("available_utc") <= cutoff)


def latest_available(rows: DataFrame, key: list[str], date: str, cutoff: Column) -> DataFrame:
    """The last row of each key that may be used at a cutoff."""
    some = available(rows, cutoff)
    columns = [c for c in rows.columns if c not in key]
    return some.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(date, "available_utc")).alias("_r")).select(*key, "_r.*")
