"""Gradient-boosted trees over whole tables, and their export.

Features become codes between quantile edges once. A tree grows level by level: one aggregation sums gradients by node, feature
and code, windows over these sums try every split with missing values on either side, and the best split of each node, a row each,
reaches the driver. Rows stay where they are; a tree is an expression over their codes, and raw scores are checkpointed now and
then so that expressions don't pile up. All classes of a round grow in the same aggregations. Exported trees are walked by another
expression, over the features themselves.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.operators import quantiles
from pulseframe.session import cut

#: Trees of one row's scores that are evaluated anew before the scores are written down.
WRITTEN = 4


@dataclass(frozen=True)
class Settings:
    """Rounds, step, levels of a tree, rows in a leaf at least, penalty on leaf values, and codes of a feature at most."""

    rounds: int = 20
    rate: float = 0.1
    levels: int = 3
    least: int = 20
    penalty: float = 1.0
    codes: int = 32


#: Digits that gains are compared with, so that sums in another order choose the same split.
DIGITS = 6


def edges(df: DataFrame, features: list[str], codes: int) -> list[list[float]]:
    """Each feature's distinct inner quantiles; as many numbers as codes reach the driver."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f).cast("double").alias("v")) for j, f in enumerate(features)])))
    got = quantiles.exact(long, "v", [k / codes for k in range(1, codes)], ["j"]).groupBy("j").agg(F.sort_array(F.collect_set("quantile")).alias("e")).collect()
    found = {r["j"]: r["e"] for r in got}
    return [found.get(j, []) for j in range(len(features))]


def code(x: Column, cuts: list[float]) -> Column:
    """How many edges lie below x, by bisection; null where x is missing."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(x.isNotNull() & ~F.isnan(x), search(0, len(cuts)))


def _goes(tree: dict) -> Column:
    """The node that a row reaches, by codes c0, c1, ..; grows with the tree."""

    def down(i: int) -> Column:
        if tree["feature"][i] < 0:
            return F.lit(i)
        c = F.col(f"c{tree['feature'][i]}")
        left = F.when(c.isNull(), F.lit(bool(tree["missing_left"][i]))).otherwise(c <= tree["code"][i])
        return F.when(left, down(tree["left"][i])).otherwise(down(tree["right"][i]))

    return down(0)


def _leaf(tree: dict) -> int:
    for k, v in (("feature", -1), ("code", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("missing_left", 0), ("value", 0.0)):
        tree[k].append(v)
    return len(tree["feature"]) - 1


def split_gains(sums: DataFrame, s: Settings) -> DataFrame:
    """(k, node, j, code, missing_left, gain, g_left, h_left, g_right, h_right): the best split of each node, from (k, node, j, code, g, h, n) with code null for missing values."""
    w = W.partitionBy("k", "node", "j")
    upto = w.orderBy("code").rowsBetween(W.unboundedPreceding, 0)
    known = F.col("code").isNotNull()
    part = lambda c, over: F.coalesce(F.sum(F.when(known, F.col(c))).over(over), F.lit(0))
    t = sums.select("k", "node", "j", "code", *[part(c, upto).alias(f"{c}_in") for c in "ghn"], *[F.sum(c).over(w).alias(f"{c}_all") for c in "ghn"], *[part(c, w).alias(f"{c}_known") for c in "ghn"])
    t = t.where(known).withColumn("missing_left", F.explode(F.array(F.lit(0), F.lit(1))))
    left = {c: F.col(f"{c}_in") + F.col("missing_left") * (F.col(f"{c}_all") - F.col(f"{c}_known")) for c in "ghn"}
    t = t.withColumns({f"{c}_left": left[c] for c in "ghn"}).withColumns({f"{c}_right": F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn"})
    score = lambda side: F.pow(F.col(f"g_{side}"), F.lit(2)) / (F.col(f"h_{side}") + s.penalty)
    gain = F.round(score("left") + score("right") - score("all"), DIGITS)
    t = t.withColumn("gain", gain).where((F.col("n_left") >= s.least) & (F.col("n_right") >= s.least) & (F.col("gain") > 0))
    best = F.max_by(F.struct("j", "code", "missing_left", "gain", "g_left", "h_left", "g_right", "h_right"), F.struct("gain", -F.col("j"), -F.col("code"), -F.col("missing_left")))
    return t.groupBy("k", "node").agg(best.alias("b")).select("k", "node", "b.*")


def _grow(rows: DataFrame, k: int, m: int, cuts: list[list[float]], s: Settings) -> list[dict]:
    """One tree for each of k outputs, from codes c0.. and gradients g0.., h0..."""
    trees = [{n: [] for n in ("feature", "code", "threshold", "left", "right", "missing_left", "value")} for _ in range(k)]
    for t in trees:
        _leaf(t)
    open_ = {(i, 0) for i in range(k)}
    for level in range(s.levels):
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), _goes(t).alias("node"), F.col(f"g{i}").alias("g"), F.col(f"h{i}").alias("h")) for i, t in enumerate(trees)]))
        x = rows.select(*[f"c{j}" for j in range(m)], each.alias("x")).select("x.*", F.posexplode(F.array(*[F.col(f"c{j}") for j in range(m)])).alias("j", "code"))
        if level:
            x = x.where((F.col("k") * F.lit(1 << 16) + F.col("node")).isin([(a << 16) + b for a, b in sorted(open_)]))
        sums = x.groupBy("k", "node", "j", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
        if level == 0:
            total = sums.where("j = 0").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for r in total:
                trees[r["k"]]["value"][0] = -s.rate * r["g"] / (r["h"] + s.penalty)
        fresh = set()
        for r in sorted(split_gains(sums, s).collect(), key=lambda r: (r["k"], r["node"])):  # a row for each node
            t, i = trees[r["k"]], r["node"]
            t["feature"][i], t["code"][i], t["threshold"][i], t["missing_left"][i] = r["j"], r["code"], cuts[r["j"]][r["code"]] if r["code"] < len(cuts[r["j"]]) else math.inf, r["missing_left"]
            t["left"][i], t["right"][i] = _leaf(t), _leaf(t)
            for side in ("left", "right"):
                t["value"][t[side][i]] = -s.rate * r[f"g_{side}"] / (r[f"h_{side}"] + s.penalty)
                fresh.add((r["k"], t[side][i]))
        open_ = fresh
        if not open_:
            break
    return trees


def fit(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), key: str | None = None) -> tuple[dict, DataFrame]:
    """(bundle {classes, baseline, features, trees}, rows with (key,) y and raw, the fitted scores).

    One tree a round for two classes, else one for each class. Rows without a label are left out; missing features, null or NaN,
    go to the side that fits them better. Classes are few, and sorted.
    """
    s = settings
    src = df.where(F.col(label).isNotNull()).select(*([F.col(key).alias("key")] if key else []), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)], F.col(label).alias("y"))
    src = cut(src)
    counts = sorted((r["y"], r["n"]) for r in src.groupBy("y").agg(F.count("*").alias("n")).collect())
    classes, n = [c for c, _ in counts], sum(v for _, v in counts)
    outs = classes[-1:] if len(classes) <= 2 else classes
    shares = [min(max(dict(counts)[c] / n, 1e-9), 1 - 1e-9) for c in outs]
    base = [math.log(p / (1 - p)) for p in shares] if len(classes) <= 2 else [math.log(p) - sum(map(math.log, shares)) / len(shares) for p in shares]
    cuts = edges(src, [f"x{j}" for j in range(len(features))], s.codes)
    kept = ["key"] * bool(key) + ["y"]
    rows = src.select(*kept, *[code(F.col(f"x{j}"), c).alias(f"c{j}") for j, c in enumerate(cuts)], *[F.lit(b).alias(f"f{i}") for i, b in enumerate(base)])
    rows, trees = cut(rows), []
    for turn in range(s.rounds if len(classes) > 1 else 0):
        raw = F.array(*[F.col(f"f{i}") for i in range(len(outs))])
        first = 1 if len(outs) == 1 else 0
        hit = [(F.col("y") == F.lit(c)).cast("double") for c in outs]
        graded = rows.withColumn("p", softmax(raw))
        graded = graded.withColumns({f"p{i}": F.get("p", F.lit(i + first)) for i in range(len(outs))}).withColumns({**{f"g{i}": F.col(f"p{i}") - hit[i] for i in range(len(outs))}, **{f"h{i}": F.col(f"p{i}") * (1 - F.col(f"p{i}")) for i in range(len(outs))}})
        stage = _grow(graded, len(outs), len(features), cuts, s)
        trees.append(stage)
        rows = rows.withColumns({f"f{i}": F.col(f"f{i}") + F.get(F.array(*[F.lit(float(v)) for v in t["value"]]), _goes(t)) for i, t in enumerate(stage)})
        if turn % max(1, WRITTEN // len(outs)) == 0:
            rows = cut(rows)
    fitted = rows.select(*kept, F.array(*[F.col(f"f{i}") for i in range(len(outs))]).alias("raw"))
    return {"classes": classes, "baseline": base, "features": features, "trees": trees}, fitted


def nodes(bundle: dict) -> list[tuple[int, int, str, str | None, float | None, int | None, float]]:
    """(round, output, path of L and R, feature, threshold, missing_left, value) of all nodes; the last three but value are None at leaves."""
    out = []

    def walk(turn: int, k: int, t: dict, i: int, path: str) -> None:
        inner = t["feature"][i] >= 0
        out.append((turn, k, path, *((bundle["features"][t["feature"][i]], t["threshold"][i], t["missing_left"][i]) if inner else (None, None, None)), t["value"][i]))
        if inner:
            walk(turn, k, t, t["left"][i], path + "L")
            walk(turn, k, t, t["right"][i], path + "R")

    for turn, stage in enumerate(bundle["trees"]):
        for k, t in enumerate(stage):
            walk(turn, k, t, 0, "")
    return out


def scores(bundle: dict, features: Column) -> Column:
    """array<double>: raw scores of an array of features (null or NaN where missing), by folds over exported trees. The bundle is one literal."""
    flat = [{"k": k, **{n: v if n != "threshold" else [min(x, 1.7e308) for x in v] for n, v in tree.items()}} for stage in bundle["trees"] for k, tree in enumerate(stage)]
    kind = "array<struct<k:int,feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,missing_left:array<int>,value:array<double>>>"
    trees = F.from_json(F.lit(json.dumps(flat)), kind)

    def leaf(t: Column) -> Column:
        def down(i: Column, _: Column) -> Column:
            f = F.get(t["feature"], i)
            v = F.get(features, f)
            left = F.when(v.isNull() | F.isnan(v), F.get(t["missing_left"], i) == 1).otherwise(v <= F.get(t["threshold"], i))
            return F.when(f < 0, i).when(left, F.get(t["left"], i)).otherwise(F.get(t["right"], i))

        return F.aggregate(t["feature"], F.lit(0), down)  # as many steps as nodes are enough

    start = F.array(*[F.lit(float(b)) for b in bundle["baseline"]])
    return F.aggregate(trees, start, lambda acc, t: F.transform(acc, lambda v, k: v + F.when(k == t["k"], F.get(t["value"], leaf(t))).otherwise(F.lit(0.0))))


def softmax(raw: Column) -> Column:
    """Probabilities of raw scores; one score stands for the second of two classes."""
    one = 1 / (1 + F.exp(-F.get(raw, F.lit(0))))
    top = F.array_max(raw)
    e = F.transform(raw, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(raw) == 1, F.array(1 - one, one)).otherwise(F.transform(e, lambda v: v / total))
