"""Importance, decay, ranking and cost as Column functions: all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base importance by type, boost by source, hook-rank penalty tier by type.
TYPE_BASE = {"preference": 0.9, "decision": 0.8, "pattern": 0.7, "discovery": 0.6, "entity": 0.5, "tool": 0.4, "session": 0.3}
SOURCE_BOOST = {"reflect": 0.15, "manual": 0.1, "mentor": 0.1, "research": 0.05, "wrap": 0.0, "hook": -0.2, "consolidation": -0.1}
TYPE_TIER = {"decision": 0, "discovery": 0, "pattern": 0, "preference": 0, "entity": 1, "session": 2}
DEFAULT_IMPORTANCE = 0.5
RRF_K = 60

#: Dollars a million tokens, (in, out), by price class of the scoring model; unknown classes cost as ``nano``.
RATES = {"mini": (0.75, 4.5), "nano": (0.2, 1.25), "small": (0.15, 0.6), "large": (2.5, 10.0)}


def lookup(key: Column, table: dict, default: float) -> Column:
    """A constant table's value for a key; the default for null and unknown keys."""
    out = F.lit(float(default))
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def initial_importance(kind: Column, source: Column) -> Column:
    """Base of the type plus boost of the source, between 0 and 1.

    A source whose boost is 0 and whose name holds ``hook`` counts as a hook.
    """
    boost = lookup(source, SOURCE_BOOST, 0)
    boost = F.when((boost == 0) & F.coalesce(source.contains("hook"), F.lit(False)), F.lit(SOURCE_BOOST["hook"])).otherwise(boost)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lookup(kind, TYPE_BASE, DEFAULT_IMPORTANCE) + boost))


def decay(importance: Column, days: Column) -> Column:
    """Exponential decay that slows with importance; unchanged where either is not positive."""
    return F.when((importance <= 0) | (days <= 0), importance).otherwise(importance * F.exp(F.lit(-0.16) * (1 - 0.8 * importance) * days))


def access_boost(importance: Column, accesses: Column) -> Column:
    """Importance raised by the logarithm of accesses, at most 1."""
    return F.when(accesses <= 0, importance).otherwise(F.least(F.lit(1.0), importance + 0.03 * F.log1p(accesses)))


def hub_boost(degree: Column) -> Column:
    """0.02 for each edge, for ten edges at most."""
    return 0.02 * F.least(F.coalesce(degree, F.lit(0)), F.lit(10))


def rrf(*positions: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion of 1-based or 0-based positions; a null position adds nothing."""
    out = F.lit(0.0)
    for p in positions:
        out = out + F.coalesce(1.0 / (F.lit(float(k)) + p), F.lit(0.0))
    return out


def recall_weight(score: Column, importance: Column) -> Column:
    """Recall's importance weighting: half at importance 0, whole at 1."""
    return score * (0.5 + 0.5 * F.coalesce(importance, F.lit(DEFAULT_IMPORTANCE)))


def hook_score(score: Column, importance: Column, kind: Column, created_today: Column) -> Column:
    """The prompt path's ranking: milder importance weight, a penalty by type tier and a bonus for today's rows."""
    weighted = score * (0.7 + 0.3 * F.coalesce(importance, F.lit(DEFAULT_IMPORTANCE)))
    return weighted - 0.001 * lookup(kind, TYPE_TIER, 2) + F.when(created_today, 0.005).otherwise(0.0)


def cost(tokens_in: Column, tokens_out: Column, price_class: Column, flex: Column) -> Column:
    """Dollars for a scoring call; half in the flexible tier."""
    rate_in = lookup(price_class, {k: v[0] for k, v in RATES.items()}, RATES["nano"][0])
    rate_out = lookup(price_class, {k: v[1] for k, v in RATES.items()}, RATES["nano"][1])
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6 * F.when(flex, 0.5).otherwise(1.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def age_label(newer: Column, older: Column) -> Column:
    """``Nd ago``, ``Nh ago`` or ``earlier``; ``older`` where a time is missing."""
    seconds = F.unix_seconds(newer) - F.unix_seconds(older)
    days, hours = F.floor(seconds / 86400), F.floor(seconds / 3600)
    label = F.when(days >= 1, F.concat(days.cast("string"), F.lit("d ago"))).when(hours >= 1, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise("earlier")
    return F.when(seconds.isNull(), "older").otherwise(label)


def age_suffix(now: Column, created: Column) -> Column:
    """`` (Nd ago)`` from two days on, else empty."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / 86400)
    return F.when(days >= 2, F.concat(F.lit(" ("), days.cast("string"), F.lit("d ago)"))).otherwise("")


def oversample(k: int) -> int:
    """Candidates fetched for k results."""
    return min(max(2 * k, 8), 12)
