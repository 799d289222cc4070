"""Market-wide transitions: robust components of each date, a calibration on earlier dates, scores by family, labels and impact.

Every component needs broad participation: it is a median, a quantile or a share over at least ``least`` entities, so that one
entity alone cannot make an event. A date's entities are one group; the calibration is one row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the components of each family, and those whose size counts whatever their sign
FAMILIES = {
    "price_co_movement": ("median_return", "median_absolute_return", "q75_absolute_return", "return_breadth", "robust_return_coherence"),
    "market_activity": ("volume_median_z", "volume_q75_z", "volume_participation_z1", "volume_delta_median_z", "value_median_z", "value_q75_z", "value_participation_z1", "value_delta_median_z"),
    "node_state": ("common_state_energy", "node_state_median_energy", "node_state_q75_energy", "state_change_participation", "state_feature_breadth"),
    "topology": ("market_corr_level", "market_corr_change", "state_coherence"),
}
SIGNLESS = ("median_return", "return_breadth", "robust_return_coherence")
COMPONENTS = [c for names in FAMILIES.values() for c in names]
EVENTS = {"price_co_movement": "price_transition", "market_activity": "activity_transition", "node_state": "node_state_transition", "topology": "topology_transition"}


def _total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def components(rows: DataFrame, state: list[str], path: str, volume: str, value: str, corr: str, least: int = 20, state_change: float = 0.75, feature_change: float = 0.25, ahead: str = "_next") -> DataFrame:
    """One row a date: observed_nodes, market_return, return_concentration, total_state_energy and the COMPONENTS.

    rows: one an entity and date, with its path return from entry, its state features (on one scale), its volume and value z-scores and its correlation
    to the market, each now and, under the name with ``ahead``, at the path's end; null where it is not available."""
    c = F.col
    delta = {f: c(f + ahead) - c(f) for f in state}
    n = _total([d.isNotNull().cast("int") for d in delta.values()])
    squares = _total([F.coalesce(d * d, F.lit(0.0)) for d in delta.values()])
    needed = max(3, math.ceil(len(state) * 0.25))
    r = rows.withColumns({f"_d_{f}": d for f, d in delta.items()} | {"_n": n, "_sq": squares, "_energy": F.when(n >= needed, F.sqrt(squares / n)), "_abs": F.abs(path), "_p2": c(path) * c(path), "_sign": F.signum(path)})
    enough = lambda x, y: F.when(F.count(x) >= least, y)
    med, q75 = (lambda x: F.percentile(x, 0.5)), (lambda x: F.percentile(x, 0.75))
    out = {
        "observed_nodes": F.when(F.count(path) >= least, F.count(path)).otherwise(0),
        "market_return": enough(path, F.avg(path)),
        "median_return": enough(path, med(path)),
        "median_absolute_return": enough(path, med("_abs")),
        "q75_absolute_return": enough(path, q75("_abs")),
        "return_breadth": enough(path, F.avg("_sign")),
        "return_concentration": enough(path, F.when(F.sum("_p2") > 1e-16, F.max("_p2") / F.sum("_p2")).otherwise(0.0)),
        "total_state_energy": F.sqrt(F.sum("_sq") / F.nullif(F.sum("_n"), F.lit(0))),
        "node_state_median_energy": enough("_energy", med("_energy")),
        "node_state_q75_energy": enough("_energy", q75("_energy")),
        "state_change_participation": enough("_energy", F.avg((c("_energy") >= state_change).cast("int"))),
        "market_corr_level": enough(corr + ahead, med(corr + ahead)),
        "_corr": enough(corr, med(corr)),
    }
    for name, x in (("volume", volume), ("value", value)):
        y = x + ahead
        out |= {
            f"{name}_median_z": enough(y, med(y)),
            f"{name}_q75_z": enough(y, q75(y)),
            f"{name}_participation_z1": enough(y, F.avg((c(y) >= 1).cast("int"))),
            f"{name}_delta_median_z": enough(c(y) - c(x), med(c(y) - c(x))),
        }
    g = r.groupBy("date").agg(*[v.alias(k) for k, v in out.items()], *[enough(f"_d_{f}", med(f"_d_{f}")).alias(f"_c_{f}") for f in state])
    centres = [c(f"_c_{f}") for f in state]
    usable = F.nullif(_total([x.isNotNull().cast("int") for x in centres]), F.lit(0))
    g = g.withColumns(
        {
            "robust_return_coherence": F.when(c("median_absolute_return") > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("median_return") / c("median_absolute_return")))).when(c("median_absolute_return").isNotNull(), 0.0),
            "common_state_energy": F.sqrt(_total([F.coalesce(x * x, F.lit(0.0)) for x in centres]) / usable),
            "state_feature_breadth": _total([F.coalesce((F.abs(x) >= feature_change).cast("int"), F.lit(0)) for x in centres]) / usable,
            "market_corr_change": c("market_corr_level") - c("_corr"),
        }
    )
    coherence = F.when(c("common_state_energy").isNotNull(), F.when(c("total_state_energy") > 1e-12, c("common_state_energy") / c("total_state_energy")).when(c("total_state_energy") == 0, 0.0))
    return g.withColumn("state_coherence", coherence).select("date", "observed_nodes", "market_return", "return_concentration", "total_state_energy", *COMPONENTS)


def magnitude(name: str) -> Column:
    x = F.col(name)
    return F.abs(x) if name in SIGNLESS else F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def calibration(fit: DataFrame, scale_quantile: float = 0.9, event_quantile: float = 0.95) -> DataFrame:
    """One row from dates of ``components``: centre and scale of each component, threshold of each family, and the bounds of a broad selloff.

    A component's scale is its upper quantile less the median, the population deviation where that is nil, 1 where both are. Fewer than twenty values of a component or
    of a family are an error."""
    m = fit.select("median_return", "return_breadth", *[magnitude(c).alias(f"_{c}") for c in COMPONENTS])
    mid = {c: F.percentile(f"_{c}", 0.5) for c in COMPONENTS}
    wide = {c: F.percentile(f"_{c}", scale_quantile) - mid[c] for c in COMPONENTS}
    scale = lambda c: F.when(wide[c] > 1e-12, wide[c]).when(F.stddev_pop(f"_{c}") > 1e-12, F.stddev_pop(f"_{c}")).otherwise(1.0)
    must = lambda n, name, x: F.when(n >= 20, x).otherwise(F.raise_error(F.lit(f"fewer than twenty fit values: {name}")).cast("double"))
    low = lambda c: F.when(F.count(c) >= 20, F.percentile(c, 0.1))
    one = m.agg(*[must(F.count(f"_{c}"), c, mid[c]).alias(f"centre_{c}") for c in COMPONENTS], *[scale(c).alias(f"scale_{c}") for c in COMPONENTS], low("median_return").alias("selloff_return"), low("return_breadth").alias("selloff_breadth"))
    families = scored(fit, one).agg(*[must(F.count(f"family_{f}"), f, F.percentile(f"family_{f}", event_quantile)).alias(f"threshold_{f}") for f in FAMILIES])
    return one.join(F.broadcast(families), F.lit(True))


def scored(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows of ``components`` with score_<component> within 0..20, family_<family>, null unless all its components are known, and systemic_energy, the greatest family, null unless all are known."""
    j = rows.join(F.broadcast(fitted), F.lit(True))  # one row
    score = {f"score_{c}": F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(20.0), (magnitude(c) - F.col(f"centre_{c}")) / F.col(f"scale_{c}")))) for c in COMPONENTS}
    j = j.withColumns(score)
    j = j.withColumns({f"family_{f}": F.sqrt(_total([F.col(f"score_{c}") ** 2 for c in names]) / len(names)) for f, names in FAMILIES.items()})
    known = reduce(lambda a, b: a & b, [F.col(f"family_{f}").isNotNull() for f in FAMILIES])
    j = j.withColumn("systemic_energy", F.when(known, F.greatest(*[F.col(f"family_{f}") for f in FAMILIES])))
    return j.select(*rows.columns, *score, *[f"family_{f}" for f in FAMILIES], "systemic_energy")


def labelled(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows of ``components`` with their scores, the events, systemic_event (any of them) and systemic_impact.

    A family has an event from its threshold on; a broad selloff is a date whose median return and breadth both lie in the lowest tenth of the
    fit. The impact is the greatest family over its threshold, 1 at least in a selloff, null unless all families are known."""
    s = scored(rows, fitted)
    bounds = fitted.select("selloff_return", "selloff_breadth", *[f"threshold_{f}" for f in FAMILIES])
    j = s.join(F.broadcast(bounds), F.lit(True))
    event = {name: F.coalesce(F.col(f"family_{f}") >= F.col(f"threshold_{f}"), F.lit(False)) for f, name in EVENTS.items()}
    selloff = F.coalesce((F.col("median_return") <= F.col("selloff_return")) & (F.col("return_breadth") <= F.col("selloff_breadth")), F.lit(False))
    j = j.withColumns(event | {"broad_selloff": selloff})
    salience = [F.col(f"family_{f}") / F.greatest(F.col(f"threshold_{f}"), F.lit(1e-12)) for f in FAMILIES]
    impact = F.when(F.col("systemic_energy").isNotNull(), F.greatest(*salience, F.col("broad_selloff").cast("double")))
    j = j.withColumns({"systemic_event": reduce(lambda a, b: a | b, [F.col(n) for n in EVENTS.values()]) | F.col("broad_selloff"), "systemic_impact": impact})
    return j.select(*s.columns, *EVENTS.values(), "broad_selloff", "systemic_event", "systemic_impact")
