"""Embedding near-dedup by counting collisions of one-dimensional projections.

Equal vectors become one class first. Unit vectors are projected on random directions; on each, two vectors whose
cosine is at the threshold differ by a normal deviate with a known spread. The work has four steps:

* Lists. A table is a group of directions, whose lines are cut into cells; vectors that share all cells of a table
  form a list. The number of directions in a table grows with the logarithm of the largest label, so that lists of unrelated
  vectors are rare; the number of tables is what the recall at the threshold then needs. Work grows with a power of the rows below 2.
* Cliques. A vector's hub is the smallest id in some of its lists within half the angle of the threshold. Vectors of one hub
  link with one another for certain, so that a large group of near copies is counted, never paired.
* Counts. For pairs of a list with unlike hubs, windows centred on one's values on further directions hold the other's or
  don't; pairs that collide often enough, by a count calibrated for the recall, pass.
* Verification of the pairs that pass, by their cosine in double precision.

Defined results: vectors that are null, empty or zero or hold null or non-finite components link with nothing,
nor do rows whose label or id is null; labels may be of any type; vectors of unlike length don't link; rows that repeat an id are rows of
their own with one id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, components

#: Width of a cell, directions whose collisions are counted, and half the width of their windows in standard deviations at the threshold.
CELL, DIRECTIONS, REACH = 2.0, 32, 2.5
#: The least shares of pairs at the threshold that meet in some table, and that pass the count.
MEET, RECALL = 0.99, 0.9995
#: Directions in a table beyond those that leave about one unrelated vector in a list.
EXTRA = 3
#: Tables in which hubs are looked for: near copies share one of so many almost surely, and those that don't are paired like others.
HUB_TABLES = 16
#: Vectors of a list that are compared at once with as many others.
PART = 1024
#: What rounding may add to a cosine.
SLACK = 1e-9
SEED = 11


def least_collisions(directions: int = DIRECTIONS, reach: float = REACH, recall: float = RECALL) -> int:
    """The largest count that pairs at the threshold reach with the probability `recall`, directions being independent."""
    p = math.erf(reach / math.sqrt(2))
    for count in range(directions, 0, -1):
        if sum(math.comb(directions, i) * p**i * (1 - p) ** (directions - i) for i in range(count, directions + 1)) >= recall:
            return count
    return 0


def one_cell(spread: float, cell: float = CELL) -> float:
    """The probability that values which differ by a normal deviate share a cell with a random edge."""
    z = cell / spread
    inside = math.erf(z / math.sqrt(2))
    return inside - (1 - math.exp(-z * z / 2)) * math.sqrt(2 / math.pi) / z


@dataclass(frozen=True)
class Plan:
    """Tables of so many directions each."""

    directions: int
    tables: int
    threshold: float

    @property
    def spread(self) -> float:
        return math.sqrt(2 - 2 * self.threshold)


def plan_for(largest: int, threshold: float) -> Plan:
    """Lists of unrelated vectors hold a few at most; tables as many as MEET needs."""
    near, far = one_cell(math.sqrt(2 - 2 * threshold)), one_cell(math.sqrt(2))
    directions = max(2, math.ceil(math.log(max(largest, 2)) / -math.log(far)) + EXTRA)
    return Plan(directions, max(1, math.ceil(math.log(1 - MEET) / math.log1p(-(near**directions)))), threshold)


_DIRECTIONS: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def directions_of(width: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions that count, directions of the tables, edges of their cells); drawn once in a worker."""
    key = (width, plan)
    if key not in _DIRECTIONS:
        r = np.random.default_rng([SEED, width])
        n = plan.directions * plan.tables
        _DIRECTIONS[key] = (r.normal(size=(width, DIRECTIONS)), r.normal(size=(width, n)), r.uniform(0, CELL, n))
    return _DIRECTIONS[key]


def unit_vectors(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def list_keys(units: np.ndarray, plan: Plan) -> np.ndarray:
    """A 64-bit key for each vector and table, from the cells that it falls in. Unlike cells that share a key cost time only."""
    _, r, edges = directions_of(units.shape[1], plan)
    odd = np.random.default_rng(SEED).integers(1 << 62, size=r.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor((units @ r + edges) / CELL).astype(np.int64).view(np.uint64)
    sums = (cells * odd).reshape(len(units), plan.tables, plan.directions).sum(2, dtype=np.uint64)
    return (sums ^ (np.arange(1, plan.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def pairs_of(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike hubs in whole lists (k, p, q, part, hub, cid) that are sorted by the first three and hub; lists of two parts pair these."""
    k, p, q, part, hub, cid = (lists[c].to_numpy() for c in ("k", "p", "q", "part", "hub", "cid"))
    n = len(k)
    new_list = np.ones(n + 1, bool)
    new_list[1:n] = (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    new_run = new_list.copy()
    new_run[1:n] |= hub[1:] != hub[:-1]
    nxt = lambda new: np.flatnonzero(new)[np.searchsorted(np.flatnonzero(new), np.arange(n), "right")]
    j, end = nxt(new_run), nxt(new_list)
    i, xs, ys = np.arange(n), [], []
    while True:
        open_ = j < end
        i, j, end = i[open_], j[open_], end[open_]
        if not len(i):
            break
        some = (part[i] != part[j]) | (p[i] == q[i])
        xs.append(cid[i[some]])
        ys.append(cid[j[some]])
        j = j + 1
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return both[0], both[1]


def collisions(a: np.ndarray, b: np.ndarray, spread: float) -> np.ndarray:
    """On how many directions the values of b lie in the window around those of a, by row."""
    return (np.abs(a - b) <= np.float32(REACH * spread)).sum(1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(vec_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    takes_part = F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & fine, F.lit(False))
    x = F.transform(x, lambda e: e + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(takes_part, F.col(label_col).cast("string")).alias("label"), F.when(takes_part, x).alias("x"))
    valid = rows.where("x is not null")
    classes = scratch.save(valid.groupBy("label", "x").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")), "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    plan = plan_for(sizes.agg(F.max("n")).first()[0] or 0, threshold)
    placed = scratch.save(_placed(classes, plan), "placed")
    cliques = scratch.save(_cliques(placed, plan), "cliques")
    pairs = scratch.save(_pairs(placed, cliques), "pairs")
    links = scratch.save(_verified(pairs, placed, plan), "links")

    # links within a clique are counted, those across it listed
    copies = classes.select("cid", "copies")
    sized = cliques.join(copies, "cid")
    whole = sized.groupBy("hub").agg(F.sum("copies").alias("in_clique"))
    both = links.union(links.select("b", "a"))
    near = both.join(copies, both["b"] == copies["cid"]).groupBy("a").agg(F.sum("copies").alias("others"))
    comp = components(spark, links.union(cliques.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))))
    per_class = sized.join(whole, "hub").select("cid", "in_clique")
    per_class = classes.join(per_class, "cid").join(near, classes["cid"] == near["a"], "left").join(comp, classes["cid"] == comp["id"], "left")
    per_class = per_class.select("label", "x", (F.col("in_clique") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    linked = valid.join(per_class, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _placed(classes: DataFrame, plan: Plan) -> DataFrame:
    """(cid, label, dims, unit, at, keys): the unit vector, its values on the directions that count, and the keys of its lists."""

    def run(batches):
        for b in batches:
            for dims, some in b.groupby(b["x"].map(len)):
                units = unit_vectors(some["x"].tolist())
                at = (units @ directions_of(int(dims), plan)[0]).astype(np.float32)
                yield pd.DataFrame({"cid": some["cid"], "label": some["label"], "dims": int(dims), "unit": [u.tobytes() for u in units], "at": [v.tobytes() for v in at], "keys": list(list_keys(units, plan))})

    out = classes.select("cid", "label", "x").mapInPandas(run, "cid long, label string, dims int, unit binary, at binary, keys array<long>")
    own = F.xxhash64("label", "dims")
    return out.withColumn("keys", F.transform("keys", lambda k: k.bitwiseXOR(own)))


def _cosines(pdf: pd.DataFrame, a: str, b: str) -> np.ndarray:
    """Of unit vectors in two columns, where labels and widths are alike; elsewhere nothing."""
    out = np.full(len(pdf), -2.0)
    for dims, at in pdf.groupby("dims").indices.items():
        x, y = (np.frombuffer(b"".join(pdf[c].iloc[at]), float).reshape(len(at), dims) for c in (a, b))
        out[at] = np.einsum("nd,nd->n", x, y)
    return out


def _both_sides(pairs: DataFrame, placed: DataFrame, a: str, b: str, *cols: str) -> DataFrame:
    """pairs with columns of either side, and dims, where labels and widths are alike."""
    side = lambda k, t: placed.select(F.col("cid").alias(k), F.col("label").alias(f"label_{t}"), F.col("dims").alias(f"dims_{t}"), *[F.col(c).alias(f"{c}_{t}") for c in cols])
    met = pairs.join(side(a, "a"), a).join(side(b, "b"), b).where("label_a = label_b and dims_a = dims_b")
    return met.select(a, b, F.col("dims_a").alias("dims"), *[f"{c}_{t}" for c in cols for t in "ab"])


def _cliques(placed: DataFrame, plan: Plan) -> DataFrame:
    """(cid, hub): the smallest id in a vector's first lists within half the threshold's angle; without one, its own."""
    sure = math.cos(math.acos(plan.threshold) / 2) + SLACK
    listed = placed.select("cid", F.explode(F.slice("keys", 1, HUB_TABLES)).alias("k"))
    lowest = listed.groupBy("k").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1").select("k", "hub")
    some = listed.join(lowest, "k").where("cid <> hub").select("cid", "hub").distinct()

    def run(batches):
        for b in batches:
            yield b.loc[_cosines(b, "unit_a", "unit_b") >= sure, ["cid", "hub"]]

    close = _both_sides(some, placed, "cid", "hub", "unit").mapInPandas(run, "cid long, hub long")
    close = close.groupBy("cid").agg(F.min("hub").alias("hub"))
    return placed.select("cid").join(close, "cid", "left").select("cid", F.coalesce("hub", "cid").alias("hub"))


def _pairs(placed: DataFrame, cliques: DataFrame) -> DataFrame:
    """(a, b) of unlike hubs that meet in a list. Long lists are split into parts of bounded size, of which two meet at once."""
    listed = placed.select("cid", "keys").join(cliques, "cid").select("cid", "hub", F.explode("keys").alias("k"))
    long_ = listed.groupBy("k").agg(F.count("*").alias("n"), F.min("hub").alias("low"), F.max("hub").alias("high")).where((F.col("n") > PART) & (F.col("low") < F.col("high")))
    long_ = long_.select("k", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    if long_.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        long_ = F.broadcast(long_)
    parted = listed.join(long_, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("p"), F.greatest(p, F.col("part")).alias("q")))
    dealt = parted.select("k", "hub", "cid", "part", F.explode(others).alias("o")).select("k", "o.p", "o.q", "part", "hub", "cid")
    dealt = dealt.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q", "hub")

    def run(batches):
        held = None  # the last list may go on in the next batch
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = held.iloc[-1]
            goes_on = ((held["k"] == last["k"]) & (held["p"] == last["p"]) & (held["q"] == last["q"])).to_numpy()
            whole, held = held[~goes_on], held[goes_on]
            if len(whole):
                x, y = pairs_of(whole)
                yield pd.DataFrame({"a": x, "b": y})
        if held is not None and len(held):
            x, y = pairs_of(held)
            yield pd.DataFrame({"a": x, "b": y})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, placed: DataFrame, plan: Plan) -> DataFrame:
    """The pairs that pass the count, and then the threshold."""
    least = least_collisions()

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), np.float32).reshape(len(b), DIRECTIONS) for c in ("at_a", "at_b"))
            b = b[collisions(x, y, plan.spread) >= least]
            yield b.loc[_cosines(b, "unit_a", "unit_b") >= plan.threshold, ["a", "b"]]

    return _both_sides(pairs, placed, "a", "b", "at", "unit").mapInPandas(run, "a long, b long")
