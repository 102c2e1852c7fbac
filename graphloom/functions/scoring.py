"""Scores of edges and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# The default weights of the ten edge features, in order of the features.
FEATURES = ("sim", "cs", "etw", "nd", "hd", "pr", "td", "nr", "sd", "grounding")
WEIGHTS = {"sim": 0.4, "cs": 0.4, "etw": 0.1, "nd": 0.05, "hd": 0.05, "pr": 0.1, "td": 0.1, "nr": 0.05, "sd": 0.1, "grounding": 1.0}
NEGATIVE = ("nd", "sd")
COMMUNITY_DECAY = 0.5
# Decay rates of relations; others decay by COMMUNITY_DECAY.
DECAY_RATES = {"CURRENT_PRICE": 0.693, "REPORTED_AS": 0.010, "AFFILIATED_WITH": 0.001, "BORN_IN": 0.0}
# Trust in a provenance by its prefix; others 0.70.
CREDIBILITY = {"pubmed": 0.95, "wikidata": 0.90, "freebase": 0.88, "openkg": 0.85, "dbpedia": 0.85, "inferred": 0.50, "hypothesis": 0.40, "synthetic": 0.30, "rem": 0.25}
OTHER_CREDIBILITY = 0.70


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def edge_logit(features: dict[str, Column], weights: dict[str, float | Column] | None = None) -> Column:
    """Logistic weight of an edge from its ten features; absent ones count 0."""
    weights = WEIGHTS | (weights or {})
    total = F.lit(0.0)
    for name in FEATURES:
        if name in features:
            term = (weights[name] if isinstance(weights[name], Column) else F.lit(weights[name])) * features[name]
            total = total - term if name in NEGATIVE else total + term
    return sigmoid(total)


def hop_decay(hop: int | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + (hop if isinstance(hop, Column) else F.lit(hop)))


def temporal_decay(rel: Column, valid_to: Column, now: float, hyperbolic: bool = True, window: float | None = None) -> Column:
    """Decay of an edge past its validity; 0 where it is still valid or has no end."""
    age = F.lit(now) - valid_to
    rate = F.lit(COMMUNITY_DECAY)
    for name, value in DECAY_RATES.items():
        rate = F.when(rel == name, F.lit(value)).otherwise(rate)
    value = F.lit(1.0) / (F.lit(1.0) + rate * age) if hyperbolic else F.exp(-rate * age)
    if window:
        value = F.when(age > window, value * 0.1).otherwise(value)
    return F.when(age > 0, value).otherwise(F.lit(0.0))


def credibility(provenance: Column) -> Column:
    """Trust in a source: its exact name, else the prefix before the colon, else the default."""
    out = F.lit(OTHER_CREDIBILITY)
    for name, value in reversed(CREDIBILITY.items()):
        out = F.when((provenance == name) | provenance.startswith(name), F.lit(value)).otherwise(out)
    return out


def community_score(cu: Column, cv: Column, distance: Column, adjacent: Column, override: Column | None = None) -> Column:
    """Closeness of two communities; unknown ones (null or negative) 0.5, far ones by distance."""
    unknown = F.coalesce((cu < 0) | (cv < 0), F.lit(True))
    out = F.when(unknown, F.lit(0.5)).when(cu == cv, F.lit(1.0)).when(F.coalesce(adjacent, F.lit(False)), F.lit(0.5))
    out = out.otherwise(F.exp(-F.lit(COMMUNITY_DECAY) * F.least(F.coalesce(distance, F.lit(5.0)), F.lit(5.0))))
    return out if override is None else F.coalesce(override, out)


def soft_community_score(u: Column, v: Column) -> Column:
    """Overlap of two membership maps, at most 1."""
    terms = F.transform(F.map_entries(v), lambda e: e["value"] * F.coalesce(F.try_element_at(u, e["key"]), F.lit(0.0)))
    return F.least(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))


def homeostatic_scale(history: Column, target: float = 0.5, smoothing: float = 0.1) -> Column:
    """Target over the moving average of an entity's activity."""
    average = F.aggregate(history, F.lit(target), lambda s, x: s * (1 - smoothing) + x * smoothing)
    return F.lit(target) / F.greatest(average, F.lit(1e-6))


def coherence(communities: Column) -> Column:
    """Share of steps within a community, steps between known ones counting half; 1 without steps."""
    known = F.filter(communities, lambda c: c >= 0)
    n = F.size(known) - 1
    same = F.aggregate(F.zip_with(F.slice(known, 1, F.greatest(n, F.lit(0))), F.slice(known, 2, F.greatest(n, F.lit(0))), lambda a, b: F.when(a == b, 1.0).otherwise(0.5)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n <= 0, F.lit(1.0)).otherwise(same / n)


def path_confidence(confidences: Column) -> Column:
    return F.coalesce(F.array_min(confidences), F.lit(1.0))


def grounding(confidences: Column, provenances: Column) -> Column:
    """Product of confidences, a tenth off for each hop without a proper source."""
    product = F.aggregate(confidences, F.lit(1.0), lambda s, x: s * x)
    bare = F.size(F.filter(provenances, lambda p: p.isNull() | p.isin("", "triples", "manual", "unknown")))
    return F.when(F.size(confidences) == 0, F.lit(1.0)).otherwise(F.least(F.greatest(product * F.pow(F.lit(0.9), bare), F.lit(0.0)), F.lit(1.0)))


def geometric_mean(values: Column) -> Column:
    logs = F.aggregate(F.transform(values, lambda w: F.log(F.greatest(w, F.lit(1e-9)))), F.lit(0.0), lambda s, x: s + x)
    return F.exp(logs / F.size(values))


def specificity(fan_outs: Column) -> Column:
    """Geometric mean of inverse fan-outs; 1 for a path without hops."""
    return F.when(F.size(fan_outs) == 0, F.lit(1.0)).otherwise(geometric_mean(F.transform(fan_outs, lambda n: F.lit(1.0) / F.greatest(n.cast("double"), F.lit(1.0)))))


def path_score(
    weights: Column,
    communities: Column,
    confidences: Column,
    provenances: Column,
    semantic: Column | None = None,
    prior: Column | None = None,
    w_attention: float = 0.4,
    w_community: float = 0.3,
    w_semantic: float = 0.3,
    w_grounding: float = 0.2,
    w_prior: float = 0.15,
) -> Column:
    """Weighted mean of the active signals of a path, in [0, 1]; 0.5 for a path without edges."""
    total = F.lit(w_attention) * geometric_mean(weights) + F.lit(w_community) * coherence(communities) + F.lit(w_grounding) * grounding(confidences, provenances)
    active = w_attention + w_community + w_grounding
    if semantic is not None:
        total, active = total + F.lit(w_semantic) * (semantic + 1.0) / 2.0, active + w_semantic
    if prior is not None:
        total, active = total + F.lit(w_prior) * prior, active + w_prior
    return F.when(F.size(weights) == 0, F.lit(0.5)).otherwise(F.least(F.greatest(total / F.lit(active), F.lit(0.0)), F.lit(1.0)))


def posterior_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def posterior_variance(a: Column, b: Column) -> Column:
    return a * b / ((a + b) * (a + b) * (a + b + 1.0))


def entropy_share(weight: Column, window: Window) -> Column:
    """Shannon entropy of the weights in a window over the most it can be; 0 for one row."""
    p = weight / F.sum(weight).over(window)
    h = F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))).over(window)
    n = F.count("*").over(window)
    return F.when(n <= 1, F.lit(0.0)).otherwise(h / F.log2(n))


def entropy_multiplier(share: Column) -> Column:
    return F.least(F.greatest(F.lit(1.0) - share * share, F.lit(0.1)), F.lit(1.0))


def hub_penalty(degree: Column, strength: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.lit(strength) * F.log1p(degree))


def platt(score: Column, a: float, b: float) -> Column:
    return sigmoid(-(F.lit(a) * score + F.lit(b)))


def boost(fan_out: Column, gamma: float, beta: float) -> Column:
    return F.lit(gamma) * F.pow(fan_out, F.lit(beta))


def smoothed_rate(hits: Column, n: Column, smoothing: float = 1.0) -> Column:
    return (hits + smoothing) / (n + 2 * smoothing)


def relation_specificity(freq: Column, targets: Column, mean_degree: Column) -> Column:
    return (targets / freq) / (F.lit(1.0) + F.log1p(mean_degree))


def adaptive_width(base: int, conflict: float, threshold: float = 0.5, most: int = 50) -> int:
    return min(2 * base, most) if conflict > threshold else base


def strategy(entropy: float, fast: float = 0.3, deep: float = 0.7) -> str:
    return "fast" if entropy < fast else "deep" if entropy > deep else "hybrid"


def funnel_widths(hops: int, width: int, factor: float = 2.0) -> list[int]:
    """Widths per hop on a line from ``factor`` times the width to the width."""
    if hops <= 1:
        return [width] * hops
    first = width * factor
    return [max(1, round(first + (width - first) * i / (hops - 1))) for i in range(hops)]


def decayed_mean(priors: Column, decay: float = 0.8) -> Column:
    """Arithmetic mean of a path's relation priors, later hops weighing less."""
    weighted = F.aggregate(F.transform(priors, lambda p, i: p * F.pow(F.lit(decay), i)), F.lit(0.0), lambda s, x: s + x)
    weights = F.aggregate(F.transform(priors, lambda p, i: F.pow(F.lit(decay), i)), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(weighted, weights), F.lit(0.0))


def soft_boost(similarity: Column, low: Column, high: Column, factor: float, least: float = 0.0) -> Column:
    """1 to ``factor`` on the line from the least to the greatest similarity; 1 below ``least``."""
    share = F.coalesce(F.try_divide(similarity - low, high - low), F.lit(0.0))
    return F.when(similarity < least, F.lit(1.0)).otherwise(1 + (factor - 1) * share)
