"""Point-in-time frames of filings: what each session knew of each entity.

A filing row has two times: the day it became available and the end of the period it reports. Rows may be amended: a later row
of the same period replaces the earlier one from its own available day on, never before. Everything derived from other periods
(a fourth quarter as the year less three quarters, growth against the year before) uses the versions known on the filing's day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_backward
from .panel import ratio

FIELDS = ("revenue", "operating_income", "net_income", "assets", "liabilities", "equity", "cash", "eps", "shares_outstanding", "dividend_per_share")
# earned over a period; the others are measured at an instant
FLOWS = ("revenue", "operating_income", "net_income", "eps")


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _positive_log(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


FEATURES = {
    "fund_revenue_log": ("revenue", _positive_log),
    "fund_operating_income_log": ("operating_income", signed_log),
    "fund_net_income_log": ("net_income", signed_log),
    "fund_assets_log": ("assets", _positive_log),
    "fund_equity_log": ("equity", signed_log),
    "fund_cash_log": ("cash", signed_log),
    "fund_eps_signed_log": ("eps", signed_log),
    "fund_shares_log": ("shares_outstanding", _positive_log),
    "fund_dividend_per_share": ("dividend_per_share", lambda x: x),
    "fund_revenue_yoy": ("revenue_yoy", lambda x: x),
    "fund_operating_margin": ("operating_margin", lambda x: x),
    "fund_net_margin": ("net_margin", lambda x: x),
    "fund_equity_to_assets": ("equity_to_assets", lambda x: x),
    "fund_liabilities_to_equity": ("liabilities_to_equity", lambda x: x),
}


def merged(filings: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: the last non-null value of each column by ``order``."""
    o = F.struct(*order)
    return filings.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in columns])


def versions(filings: DataFrame, order: list[str]) -> DataFrame:
    """(ticker, year, quarter, available_at, flows): each period as known from a day on, with unreported flows carried from the version before."""
    keyed = _with_quarter(filings).where("year is not null")
    day = merged(keyed, ["ticker", "year", "quarter", "available_at"], order, list(FLOWS))
    w = Window.partitionBy("ticker", "year", "quarter").orderBy("available_at").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in FLOWS})


def _with_quarter(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"year": F.year("period_end"), "quarter": F.quarter("period_end")})


def filing_states(filings: DataFrame, order: list[str]) -> DataFrame:
    """One row a (ticker, available_at): its ten fields with flows of three months each, growth and four ratios.

    Rows of one day count as one filing, the last non-null value of each column by ``order``. Ratios are taken as filed. A fourth quarter's
    flows are the year's less the first three quarters', null unless all are known that day; growth is against the same quarter a year
    before as known that day. Up to eight periods are looked up for a filing, by one as-of join on period and day."""
    day = _with_quarter(merged(filings, ["ticker", "available_at"], order, ["period_end", *FIELDS]))
    own = {"_" + c: F.col(c) for c in FLOWS}
    rows = day.withColumns(
        own
        | {
            "operating_margin": ratio(F.col("operating_income"), F.col("revenue")),
            "net_margin": ratio(F.col("net_income"), F.col("revenue")),
            "equity_to_assets": ratio(F.col("equity"), F.col("assets")),
            "liabilities_to_equity": ratio(F.col("liabilities"), F.col("equity")),
        }
    )
    ask = lambda years, quarter: F.struct((F.col("year") - years).alias("year"), quarter.cast("int").alias("quarter"))
    same_year = F.filter(F.array(*[ask(0, F.lit(q)) for q in (1, 2, 3)]), lambda _: F.col("quarter") == 4)
    before = F.filter(F.array(ask(1, F.col("quarter")), *[ask(1, F.lit(q)) for q in (1, 2, 3)]), lambda s: (s["quarter"] == F.col("quarter")) | (F.col("quarter") == 4))
    asked = rows.where("year is not null").select("ticker", F.col("available_at").alias("day"), F.col("year").alias("y"), F.explode(F.concat(same_year, before)).alias("p")).select("ticker", "day", "y", "p.*")
    known = asof_backward(asked, versions(filings, order), ["ticker", "year", "quarter"], "day", "available_at", prefix="k_")
    at = lambda years, quarter, c: F.max(F.when((F.col("y") - F.col("year") == years) & (F.col("quarter") == quarter), F.col(f"k_{c}")))
    looked = known.groupBy("ticker", F.col("day").alias("available_at")).agg(*[at(0, q, c).alias(f"{c}_q{q}") for c in FLOWS for q in (1, 2, 3)], *[at(1, q, "revenue").alias(f"before_q{q}") for q in (1, 2, 3, 4)])
    j = rows.join(looked, ["ticker", "available_at"], "left")
    three = {c: F.when(F.col("quarter") == 4, F.col("_" + c) - (F.col(f"{c}_q1") + F.col(f"{c}_q2") + F.col(f"{c}_q3"))).otherwise(F.col("_" + c)) for c in FLOWS}
    # without a period there is no basis to convert from
    j = j.withColumns(three)
    year_ago = reduce(lambda out, q: out.when(F.col("quarter") == q, F.col(f"before_q{q}")), (1, 2, 3), F.when(F.col("quarter") == 4, F.col("before_q4") - (F.col("before_q1") + F.col("before_q2") + F.col("before_q3"))))
    j = j.withColumn("revenue_yoy", ratio(F.col("revenue"), year_ago) - 1)
    return j.select("ticker", "available_at", "period_end", *FIELDS, "revenue_yoy", "operating_margin", "net_margin", "equity_to_assets", "liabilities_to_equity")


def filing_frames(sessions: DataFrame, filings: DataFrame, order: list[str], lag: int = 1) -> DataFrame:
    """sessions (ticker, date; one row an entity and session) with 15 features as known ``lag`` sessions before.

    A feature is its last known value, so that a filing that leaves a field out does not hide an older one. The age counts days from the last filing."""
    names = [source for source, _ in FEATURES.values()]
    w = Window.partitionBy("ticker").orderBy("available_at").rowsBetween(Window.unboundedPreceding, 0)
    states = filing_states(filings, order).select("ticker", "available_at", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in names])
    asked = sessions.select("ticker", "date").withColumn("known_on", F.lag("date", lag).over(Window.partitionBy("ticker").orderBy("date")) if lag else F.col("date"))
    j = asof_backward(asked, states, ["ticker"], "known_on", "available_at", prefix="k_")
    return j.select("ticker", "date", *[f(F.col("k_" + source)).alias(name) for name, (source, f) in FEATURES.items()], F.datediff("date", "k_available_at").alias("fund_report_age_days"))


def coverage(frames: DataFrame, eligible: Column | None = None) -> DataFrame:
    """One row, ``coverage``: the share of known values in the frames' features, of eligible rows; a feature that nobody has does not count."""
    names = [*FEATURES, "fund_report_age_days"]
    seen = (frames if eligible is None else frames.where(eligible)).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names])
    some = reduce(lambda a, b: a + b, [F.when(F.col(c) > 0, 1).otherwise(0) for c in names])
    return seen.select(F.coalesce(F.try_divide(reduce(lambda a, b: a + b, [F.col(c) for c in names]), F.col("n") * some), F.lit(0.0)).alias("coverage"))
