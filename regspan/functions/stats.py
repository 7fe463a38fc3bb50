"""Exact and asymptotic test probabilities as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Two tables count as equally likely when their log probabilities differ by no more than this.
TIE = 1e-7


def hypergeometric_p(na: int, nb: int, drawn: int, observed: np.ndarray) -> np.ndarray:
    """Two-sided Fisher exact p of each observed count on the first side, given the margins.

    The mass function is laid out once: log probabilities by ratios from its first term, sorted, with running totals. An
    observed count's p is the total up to its own probability. Counts that the margins forbid give 1.
    """
    lo, hi = max(0, drawn - nb), min(drawn, na)
    p = np.ones(len(observed))
    ok = (observed >= lo) & (observed <= hi)
    if not ok.any():
        return p
    lf = lambda x: math.lgamma(x + 1)
    first = lf(na) - lf(lo) - lf(na - lo) + lf(nb) - lf(drawn - lo) - lf(nb - drawn + lo) - lf(na + nb) + lf(drawn) + lf(na + nb - drawn)
    k = np.arange(lo, hi, dtype=np.float64)
    log = first + np.concatenate([[0.0], np.cumsum(np.log((na - k) * (drawn - k)) - np.log((k + 1) * (nb - drawn + k + 1)))])
    ranked = np.sort(log)
    totals = np.cumsum(np.exp(ranked))
    p[ok] = np.minimum(totals[np.searchsorted(ranked, log[observed[ok] - lo] + TIE, side="right") - 1], 1.0)
    return p


def odds_ratio(ca: str, na: str, cb: str, nb: str) -> Column:
    """Sample odds ratio; NULL when a row or column of the table is empty, infinity when undefined above."""
    a, b = F.col(ca), F.col(cb)
    x, y = F.col(na) - a, F.col(nb) - b
    void = (a + b == 0) | (x + y == 0) | (F.col(na) == 0) | (F.col(nb) == 0)
    return F.when(void, F.lit(None).cast("double")).when(
        (x > 0) & (b > 0), (a * y).cast("double") / F.nullif(b * x, F.lit(0))).otherwise(F.lit(float("inf")))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: a power series below 4, a continued fraction above."""
    x = z / math.sqrt(2)
    first = F.struct((x * F.exp(-x * x) * (2 / math.sqrt(math.pi))).alias("term"), F.lit(0.0).alias("total"),
                     (x * x * 2).alias("sq"))

    def grow(erf_state: Column, erf_n: Column) -> Column:
        return F.struct((erf_state["term"] * erf_state["sq"] / (erf_n * 2 + 3)).alias("term"),
                        (erf_state["total"] + erf_state["term"]).alias("total"), erf_state["sq"].alias("sq"))

    erf = F.aggregate(F.sequence(F.lit(0), F.lit(120)), first, grow, lambda erf_end: erf_end["total"])
    frac0 = F.struct(F.lit(1.0).alias("f"), (x * x * 2).alias("sq"))

    def fold(cf_state: Column, cf_n: Column) -> Column:
        return F.struct((F.lit(1.0) + cf_n / (cf_state["sq"] * cf_state["f"])).alias("f"), cf_state["sq"].alias("sq"))

    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), frac0, fold, lambda cf_end: cf_end["f"])
    far = F.exp(-x * x) / (x * math.sqrt(math.pi) * frac) * 0.5
    return F.when(z < 4, (F.lit(1.0) - erf) * 0.5).otherwise(far)


def exact_u_tail(n1: int, n2: int) -> list[float]:
    """P(U >= u) for u = 0..n1*n2 under the null, no ties; n1 and n2 are the two group sizes."""
    size = n1 * n2
    ways = [[0] * (size + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for j in range(1, n1 + n2 + 1):  # ranks 1..n1+n2, choose n1 of them
        for picked in range(min(j, n1), 0, -1):
            shift = j - picked
            src, dst = ways[picked - 1], ways[picked]
            for u in range(size, shift - 1, -1):
                dst[u] += src[u - shift]
    total = math.comb(n1 + n2, n1)
    tail, out = 0, [0.0] * (size + 1)
    for u in range(size, -1, -1):
        tail += ways[n1][u]
        out[u] = tail / total
    return out


def mann_whitney_p(u1: Column, n1: int, n2: int, ties: Column) -> Column:
    """Two-sided p of U. ``ties`` is the sum of t^3 - t over tied values.

    Exact when there are no ties and a group has at most eight members,
    otherwise the tie-corrected normal form with continuity correction.
    """
    n = n1 + n2
    u = F.greatest(u1, F.lit(float(n1 * n2)) - u1)
    var = (F.lit(float(n + 1)) - ties / float(n * (n - 1))) * (n1 * n2 / 12.0)
    z = F.greatest((u - n1 * n2 / 2.0 - 0.5) / F.sqrt(var), F.lit(0.0))
    normal = F.when(var <= 0, 1.0).otherwise(F.least(normal_tail(z) * 2, F.lit(1.0)))
    if min(n1, n2) > 8:
        return normal
    table = F.array(*[F.lit(v) for v in exact_u_tail(n1, n2)])
    exact = F.least(F.get(table, F.round(u).cast("int")) * 2, F.lit(1.0))
    return F.when(ties > 0, normal).otherwise(exact)
