"""Processes in which events trigger others, fitted by expectation-maximisation.

Each target's rate is a background plus a kernel of every earlier event that reaches it. The expectation step shares a
target among its possible causes in proportion, by one aggregation for each target; the maximisation step needs sums of
these shares only. The background's rate and the productivity have closed forms; of the other parameters the best of
a few neighbouring values is taken, all of which one pass evaluates, and neighbours draw nearer when none is better.
The current values are among them, so that the likelihood never falls. Pairs stay where they are: they are dealt by
target once and checkpointed, and a few hundred numbers a round reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.session import cut

#: Steps to neighbouring values, as factors of e, before they are halved.
STEPS = (-1.0, 0.0, 1.0)


@dataclass(frozen=True)
class Parameters:
    """Background mu; an ancestor of magnitude m above the least triggers k e^(alpha m) events, after times t with density
    (p-1) c^(p-1) (t+c)^-p, at distances r with density (q-1)/(pi w) (1 + r^2/w)^-q over the plane, w = d^2 10^(gamma m)."""

    mu: float
    k: float
    alpha: float
    c: float
    p: float
    d: float = 0.0
    gamma: float = 0.0
    q: float = 0.0

    def delay(self, t: Column) -> Column:
        return (self.p - 1) * self.c ** (self.p - 1) * F.pow(t + self.c, F.lit(-self.p))

    def width(self, m: Column) -> Column:
        return self.d**2 * F.pow(F.lit(10.0), self.gamma * m)

    def place(self, r: Column, m: Column) -> Column:
        w = self.width(m)
        return (self.q - 1) / (math.pi * w) * F.pow(1 + r * r / w, F.lit(-self.q))

    def kernel(self, spatial: bool) -> Column:
        out = self.k * F.exp(self.alpha * F.col("dm")) * self.delay(F.col("dt"))
        return out * self.place(F.col("km"), F.col("dm")) if spatial else out


def triggered(alpha: float, c: float, p: float, t0: float, t1: float, reach: float) -> Column:
    """What an ancestor (t, dm) triggers between t0 and t1 within its reach, of productivity 1."""
    from_, to = F.greatest(F.lit(t0) - F.col("t"), F.lit(0.0)), F.least(F.lit(t1) - F.col("t"), F.lit(reach))
    left = lambda age: F.pow((age + c) / c, F.lit(1 - p))
    return F.when(to > from_, F.exp(alpha * F.col("dm")) * (left(from_) - left(to))).otherwise(0.0)


def fit(targets: DataFrame, pairs: DataFrame, ancestors: DataFrame, t0: float, t1: float, reach: float, start: Parameters, spatial: bool = False, rounds: int = 20) -> tuple[Parameters, list[float]]:
    """(parameters, log-likelihood before each round and after the last).

    targets: (id, background), a density over space, 1 without; pairs: (id, dt, dm, km) of each target with all earlier
    events at most `reach` before it; ancestors: (t, dm). Rows with nulls are left out.
    """
    met = targets.dropna().join(pairs.select("id", "dt", "dm", *["km"] * spatial).dropna(), "id", "left")
    met = cut(met.repartition("id"))
    old = cut(ancestors.select(F.col("t").cast("double"), F.col("dm").cast("double")).dropna())
    now, step, history = start, 1.0, []
    for turn in range(rounds + 1):
        near = lambda v, low=0.0: sorted({low + (v - low) * math.exp(step * s) if s else v for s in STEPS})  # noqa: B023, E731
        alphas, cs, ps = near(now.alpha), near(now.c), near(now.p, 1.0)
        ds, gammas, qs = (near(now.d), near(now.gamma), near(now.q, 1.0)) if spatial else ([], [], [])
        k = F.coalesce(now.kernel(spatial), F.lit(0.0))
        r2 = F.col("km") * F.col("km") if spatial else F.lit(0.0)
        sums = {"k": k, "m": k * F.col("dm"), **{f"c{i}": k * F.log(F.col("dt") + c) for i, c in enumerate(cs)}}
        for i, (d, g) in enumerate(product(ds, gammas)):
            sums[f"s{i}"] = k * F.log1p(r2 / replace(now, d=d, gamma=g).width(F.col("dm")))
        each = met.groupBy("id").agg(F.first("background").alias("b"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in sums.items()])
        rate = now.mu * F.col("b") + F.col("k")
        got = each.agg(F.sum(F.log(rate)).alias("ll"), F.sum(now.mu * F.col("b") / rate).alias("own"), *[F.sum(F.col(n) / rate).alias(n) for n in sums]).first().asDict()
        grid = list(product(alphas, cs, ps))
        made = old.agg(*[F.sum(triggered(*abc, t0, t1, reach)).alias(f"a{i}") for i, abc in enumerate(grid)]).first()
        at = grid.index((now.alpha, now.c, now.p))
        if got["ll"] is None:
            return now, history
        history.append(got["ll"] - now.mu * (t1 - t0) - now.k * (made[at] or 0.0))
        if turn == rounds or not got["k"]:
            break

        def gain(i: int) -> float:
            """Expected log-likelihood of the triggered part, at the productivity that is best for these values."""
            (alpha, c, p), all_ = grid[i], made[i] or 0.0  # noqa: B023
            if all_ <= 0:
                return -math.inf
            return -got["k"] * math.log(all_) + alpha * got["m"] + got["k"] * (math.log(p - 1) + (p - 1) * math.log(c)) - p * got[f"c{cs.index(c)}"]  # noqa: B023

        best = max(range(len(grid)), key=lambda i: (gain(i), i == at))
        alpha, c, p = grid[best]
        after = replace(now, mu=got["own"] / (t1 - t0), k=got["k"] / made[best], alpha=alpha, c=c, p=p)
        if spatial:
            cells = list(product(enumerate(product(ds, gammas)), qs))

            def spread(cell) -> float:
                (i, (d, g)), q = cell
                return got["k"] * (math.log(q - 1) - 2 * math.log(d)) - math.log(10.0) * g * got["m"] - q * got[f"s{i}"]  # noqa: B023

            (_, (d, g)), q = max(cells, key=lambda x: (spread(x), x[0][1] == (now.d, now.gamma) and x[1] == now.q))  # noqa: B023
            after = replace(after, d=d, gamma=g, q=q)
        still = all(getattr(after, n) == getattr(now, n) for n in ("alpha", "c", "p", "d", "gamma", "q"))
        step, now = step / 2 if still else step, after
    return now, history
