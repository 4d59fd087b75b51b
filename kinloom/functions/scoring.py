"""Edge weights as pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.schema import Settings

EPSILON = 1e-9


def normalised(weights: dict[str, float] | float, features: list[str]) -> dict[str, float]:
    """Weights of sum 1: a scalar or a zero sum is uniform, negative ones count as 0."""
    if not isinstance(weights, dict):
        return {f: 1 / len(features) for f in features}
    own = {f: max(0.0, float(weights.get(f, 0.0))) for f in features}
    total = sum(own.values())
    return {f: own[f] / total if total > 0 else 1 / len(features) for f in features}


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def unit_interval(x: Column) -> Column:
    """As clamp for values that aren't null; x stands once, so nested uses stay small."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def power_mean(values: dict[str, Column], weights: dict[str, float] | float, p: float) -> Column:
    """(sum of w v^p)^(1/p), for p = 0 the weighted geometric mean with values of at least EPSILON; values are clamped to [0, 1]."""
    if not values:
        return F.lit(0.0)
    w = normalised(weights, list(values))
    v = {f: unit_interval(F.coalesce(c, F.lit(0.0))) for f, c in values.items()}
    if p == 0:
        return F.exp(_sum([F.lit(w[f]) * F.log(F.greatest(v[f], F.lit(EPSILON))) for f in v]))
    if p < 0:
        v = {f: F.greatest(c, F.lit(EPSILON)) for f, c in v.items()}
    return F.pow(_sum([F.lit(w[f]) * F.pow(v[f], F.lit(float(p))) for f in v]), F.lit(1.0 / p))


def blended(a: Column, b: Column, s: Settings = Settings()) -> Column:
    """Two power means as one weight: rho-additive and geometric by lam, gated by min^eta, to the power gamma."""
    mixed = s.lam * (s.rho * a + (1 - s.rho) * b) + (1 - s.lam) * F.pow(a, F.lit(s.rho)) * F.pow(b, F.lit(1 - s.rho))
    return unit_interval(F.pow(unit_interval(mixed * F.pow(F.least(a, b), F.lit(s.eta))), F.lit(s.gamma)))


def means(sims: dict[str, Column], comps: dict[str, Column], w_s: dict[str, float], w_c: dict[str, float], s: Settings = Settings()) -> tuple[Column, Column]:
    """The power means of both sides over their common features."""
    both = [f for f in sims if f in comps]
    return unit_interval(power_mean({f: sims[f] for f in both}, w_s, s.p_similarity)), unit_interval(power_mean({f: comps[f] for f in both}, w_c, s.p_complementarity))


def edge_weight(sims: dict[str, Column], comps: dict[str, Column], w_s: dict[str, float], w_c: dict[str, float], s: Settings = Settings()) -> Column:
    """The edge weight in one expression; 0 without a common feature. Over many rows compute means() in a projection of its own first."""
    return blended(*means(sims, comps, w_s, w_c, s), s) if set(sims) & set(comps) else F.lit(0.0)
