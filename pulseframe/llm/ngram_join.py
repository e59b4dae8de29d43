"""N-gram Jaccard join with skipping by set relations.

A document is the set of its distinct five-word shingles. Equal sets become one class. Shingles are ordered
by rarity, counted over all documents in a fixed number of hash buckets, then by hash; the prefix of a set goes to
index lists. Two relations between sets then save work, without loss:

* Index level: entries of a list with one size and position form a block, and a block that the length or
  positional filter rules out for another block is skipped whole.
* Answer level: the set with the commonest shingles of a list is its hub and answers first, against the others in
  its range of sizes. A set highly similar to its hub takes over the hub's answers: sets that they already connect
  aren't compared again. For two sets with one hub, the intersection follows from the hub's size and from what
  either lacks of the hub and has beyond it, which is little, so that whole sets aren't read again. Only sets of
  unlike hubs are left to be verified pair by pair.

Defined results: without words, or with a null text, a set is empty and links with nothing; rows that repeat an id
are rows of their own with one id; ids must be longs, null ids link with nothing; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, bound_batches, by_bytes, components, semi_by_key

WORDS = 5
#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Hash buckets that count shingles, in slices that are summed apart.
BUCKETS, SLICES = 1 << 20, 64
#: Least similarity to a hub at which a set is kept as its difference from the hub; sets in a block of a hub's group.
CLOSE, GROUP = 0.5, 2048
#: Bytes of text that are hashed at once, if no text is longer.
AT_ONCE = 1 << 20

_RND = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for k, base in enumerate((_BASE, inverse)):
                all_ = np.full(n, base, np.uint64)
                all_[0] = 1
                _POWERS[k] = np.cumprod(all_)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The set of each text: distinct 64-bit hashes, ascending."""
    done = 0
    while done < len(texts):
        last, size = done, 0
        while last < len(texts) and (last == done or size + len(texts[last] or b"") < AT_ONCE):
            size += len(texts[last] or b"") + 1
            last += 1
        some = [t or b"" for t in texts[done:last]]
        yield from _sets_of(some)
        done = last


def _sets_of(some: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(some) + b" ", np.uint8)
    power, inverse = _powers(len(raw) + 1)
    blank = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in some]), starts, "right")
    first = np.searchsorted(of, np.arange(len(some) + 1))
    n = len(word)
    acc = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        acc = acc * _BASE + word[k : k + len(acc)]
    acc = _mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(acc[a : b - WORDS + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = _mix(h * _BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts, and few bytes, at a time become Python objects."""
    for whole in batches:
        yield from by_bytes(whole, whole.schema.get_field_index("raw"), AT_ONCE)


def bucket_counts(source: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each bucket; of fixed size, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for b in _slices(batches):
            for s in shingle_sets(b.column("raw").to_pylist()):
                np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        step = BUCKETS // SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                got[s] = got[s] + np.frombuffer(c, np.uint32) if s in got else np.frombuffer(c, np.uint32).copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([c.tobytes() for c in got.values()], pa.binary())], names=["slice", "counts"])

    parts = source.select("raw").mapInArrow(count, "slice int, counts binary").repartition(16, "slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros(BUCKETS, np.uint32)
    step = BUCKETS // SLICES
    for r in parts.collect():  # SLICES rows
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], np.uint32)
    return out


def signatures(source: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, sig, common, prefix): the set's size, digest and mean count of shingles, and its rarest shingles, as many as the prefix filter needs."""
    shared = source.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ns, sigs, means, prefixes = [], [], [], []
            for s in shingle_sets(b.column("raw").to_pylist()):
                n = len(s)
                ns.append(n)
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                rarity = shared.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                means.append(int(min(rarity.mean() * 16, 1 << 30)) if n else 0)
                keep = n - -(-NUM * n // DEN) + 1 if n else 0
                prefixes.append(s[np.argsort(rarity, kind="stable")[:keep]].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary()), pa.array(means, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "sig", "common", "prefix"])

    return source.mapInArrow(run, "doc_id long, n int, sig binary, common int, prefix array<long>")


def _whole_lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first of them, cut where it changes: a worker holds a batch and the list that it breaks off."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not len(b):
            continue
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        at = int(np.searchsorted(held[0], held[0][-1]))
        if at:
            yield [x[:at] for x in held]
            held = [x[at:] for x in held]
    if held is not None:
        yield held


def _lists(t: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(t)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
    some = b - a > 1
    return list(zip(a[some].tolist(), b[some].tolist(), strict=True))


ENTRY = ["t", "sid", "n", "pos", "common"]
ENTRY_TYPES = "t long, sid long, n int, pos int, common int"


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of lists with two sets at least, of entries sorted by list; the last of a batch waits for the next batch."""
    kept: pa.RecordBatch | None = None
    before = False  # whether the entry that waits follows one of its list
    for b in batches:
        b = b if kept is None else pa.concat_batches([kept, b])
        t = b.column("t").to_numpy()
        if not len(t):
            continue
        same = np.zeros(len(t), bool)
        same[1:] = t[1:] == t[:-1]
        same[:-1] |= same[1:]
        same[0] |= before
        yield b.slice(0, len(t) - 1).filter(pa.array(same[:-1]))
        kept, before = b.slice(len(t) - 1), bool(same[-1])
    if kept is not None and before:
        yield kept


def _possible(n1, p1, n2, p2):
    """Length and positional filters."""
    least = -(-NUM * (n1 + n2) // (NUM + DEN))
    return (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= least)


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray], directed: bool = False) -> Iterator[pa.RecordBatch]:
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    if len(x):
        lo, hi = (x, y) if directed else (np.minimum(x, y), np.maximum(x, y))
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, other) in each list: the commonest set with the others in its range of sizes, then the commonest of those left, and so on.

    Entries come sorted by list and from common to rare, so that only a batch and the hubs of the list it breaks off are held.
    """
    last, hubs = None, []  # hubs: (sid, n, pos) of the list that goes on; few, as each takes a range of sizes
    for b in batches:
        t, sid, n, pos = (b.column(c).to_numpy().astype(np.int64) for c in ("t", "sid", "n", "pos"))
        if not len(t):
            continue
        cut = np.flatnonzero(np.diff(t)) + 1
        xs, ys = [], []
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
            if t[a] != last:
                last, hubs = t[a], []
            left, k = np.arange(a, z), 0
            while len(left):
                if k == len(hubs):
                    hubs.append((sid[left[0]], n[left[0]], pos[left[0]]))
                    left = left[1:]
                hub, size, place = hubs[k]
                near = DEN * np.minimum(size, n[left]) >= NUM * np.maximum(size, n[left])
                ok = left[near & _possible(size, place, n[left], pos[left])]
                xs.append(np.full(len(ok), hub))
                ys.append(sid[ok])
                left, k = left[~near], k + 1
        yield from _unique_pairs(xs, ys, directed=True)


def _group_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of one hub, by their differences from it: one for each set and component that it meets."""
    x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    base = int(pdf["hub_size"].iloc[0])

    def common(col: str) -> np.ndarray:
        """Sizes of the intersections of two lists of arrays."""
        flat = [np.concatenate([*side[col], np.zeros(0, np.int64)]).astype(np.int64) for side in (x, y)]
        who = [np.repeat(np.arange(len(side)), side[col].map(len)) for side in (x, y)]
        tokens = np.intersect1d(*flat)
        out = np.zeros((len(x), len(y)), np.float32)
        for i in range(0, len(tokens), 4096):
            some = tokens[i : i + 4096]
            both = []
            for f, w, side in zip(flat, who, (x, y), strict=True):
                at = np.minimum(np.searchsorted(some, f), len(some) - 1)
                hit = some[at] == f
                m = np.zeros((len(side), len(some)), np.float32)
                m[w[hit], at[hit]] = 1
                both.append(m)
            out += both[0] @ both[1].T
        return out.astype(np.int64)

    lack = [side["lacks"].map(len).to_numpy() for side in (x, y)]
    more = [side["adds"].map(len).to_numpy() for side in (x, y)]
    meet = base - lack[0][:, None] - lack[1][None, :] + common("lacks") + common("adds")
    size = [base - m + k for m, k in zip(lack, more, strict=True)]
    cx, cy = x["comp"].to_numpy(), y["comp"].to_numpy()
    i, j = np.nonzero((DEN * meet >= NUM * (size[0][:, None] + size[1][None, :] - meet)) & (cx[:, None] != cy[None, :]))
    return pd.DataFrame({"a": x["sid"].to_numpy()[i], "c": cy[j], "b": y["sid"].to_numpy()[j]}).drop_duplicates(["a", "c"])[["a", "b"]]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list that nothing connects yet, with unlike hubs, and that the filters leave."""
    for lists in _whole_lists(batches, ["t", "sid", "n", "pos", "comp", "hub"]):
        yield from _rest_of(*lists)


def _rest_of(t, sid, n, pos, comp, hub) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((sid, pos, n, t))
    t, sid, n, pos, comp, hub = t[order], sid[order], n[order].astype(np.int64), pos[order].astype(np.int64), comp[order], hub[order]
    xs, ys, held = [], [], 0
    for a, z in _lists(t):
        c = comp[a:z]
        if (c == c[0]).all():
            continue
        kinds, sizes = np.unique(c, return_counts=True)
        main = kinds[np.argmax(sizes)]
        cut = np.flatnonzero((np.diff(n[a:z]) != 0) | (np.diff(pos[a:z]) != 0)) + 1
        lo, hi = np.concatenate([[0], cut]) + a, np.concatenate([cut, [z - a]]) + a  # blocks
        for b in range(len(lo)):
            mine = np.arange(lo[b], hi[b])
            mine = mine[comp[mine] != main]  # the largest part is met from the other side
            if not len(mine):
                continue
            fits = np.flatnonzero(_possible(n[lo[b]], pos[lo[b]], n[lo], pos[lo]))
            if not len(fits):
                continue
            others = np.concatenate([np.arange(lo[f], hi[f]) for f in fits])
            for some in np.array_split(mine, max(1, len(mine) * len(others) // 2_000_000)):
                open_ = (comp[some][:, None] != comp[others][None, :]) & (hub[some][:, None] != hub[others][None, :])
                i, j = np.nonzero(open_)
                xs.append(sid[some[i]])
                ys.append(sid[others[j]])
                held += len(i)
            if held > 500_000:
                yield from _unique_pairs(xs, ys)
                xs, ys, held = [], [], 0
    yield from _unique_pairs(xs, ys)


def _full_sets(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, s array<long>) of the documents that ids names, from whole texts; rows that repeat an id and its set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(b.column("raw").to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["sid", "s"])

    return semi_by_key(source.withColumnRenamed("doc_id", "sid"), ids, ["sid"]).mapInArrow(run, "sid long, s array<long>")


def _verify(source: DataFrame, pairs: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(a, b, similarity, linked, hub_size, lacks, adds) of the pairs; the last two, b's differences from a, where the two are close."""
    ids = scratch.save(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), f"{tag}-ids")
    sets = scratch.save(_full_sets(source, ids), f"{tag}-sets")
    few = pairs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    right = (F.broadcast(pairs) if few else pairs).withColumnRenamed("b", "sid")
    met = sets.join(right, "sid").select("a", F.col("sid").alias("b"), F.col("s").alias("sb"))
    both = met.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long")).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    close = F.col("i") >= CLOSE * F.col("u")
    out = both.select("a", "b", (F.col("i") / F.col("u")).alias("similarity"), (DEN * F.col("i") >= NUM * F.col("u")).alias("linked"), F.size("sa").alias("hub_size"), F.when(close, F.array_except("sa", "sb")).alias("lacks"), F.when(close, F.array_except("sb", "sa")).alias("adds"))
    out = scratch.save(out, f"{tag}-verified")
    scratch.drop(f"{tag}-sets")
    return out


def _within_groups(spark: SparkSession, first: DataFrame, comp: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links between sets of one hub that nothing connects yet; the hub of each set that has one)."""
    near = first.where("lacks is not null")
    best = near.groupBy(F.col("b").alias("sid")).agg(F.max_by(F.struct("a", "hub_size", "lacks", "adds"), F.struct("similarity", -F.col("a"))).alias("h"))
    best = best.select("sid", F.col("h.a").alias("hub"), "h.hub_size", "h.lacks", "h.adds")
    best = scratch.save(best.join(comp.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "hub", "hub_size", "lacks", "adds", F.coalesce("component", "sid").alias("comp")), "hubs")
    hub_comp = comp.select(F.col("id").alias("hub"), F.col("component").alias("hub_comp"))
    hubs = scratch.save(best.select("hub").distinct().join(hub_comp, "hub", "left"), "hub-components")  # hubs are few, and one may have most sets
    placed = best.join(F.broadcast(hubs) if hubs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hubs, "hub").withColumn("out", F.col("comp") != F.coalesce("hub_comp", "hub"))
    sizes = placed.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("ys"), F.ceil(F.count_if("out") / GROUP).cast("int").alias("xs")).where("xs > 0")
    few = sizes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    dealt = placed.join(F.broadcast(sizes) if few else sizes, "hub")  # one row for each hub with sets outside its component
    part = lambda k: F.pmod(F.xxhash64("sid"), F.col(k)).cast("int")
    cols = ["hub", "hub_size", "sid", "comp", "lacks", "adds"]
    lefts = dealt.where("out").select(*cols, F.lit(True).alias("left"), part("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"))
    rights = dealt.select(*cols, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), part("ys").alias("y"))
    links = lefts.unionByName(rights).groupBy("hub", "x", "y").applyInPandas(_group_links, "a long, b long")
    return scratch.save(links, "group-links"), best.select("sid", "hub")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    source = _source(docs, id_col, text_col)
    signed = scratch.save(signatures(source, bucket_counts(source)), "signed")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("sid"))
    members = scratch.save(signed.select("doc_id", "n", "sig").join(classes, "sig", "left").select("doc_id", "n", F.coalesce("sid", "doc_id").alias("sid")), "members")
    named = signed.join(classes.withColumnRenamed("sig", "class_sig"), (F.col("doc_id") == F.col("sid")) & (F.col("sig") == F.col("class_sig")))
    posted = named.select("sid", "n", "common", F.posexplode("prefix").alias("pos", "t")).select(*ENTRY).repartition("t").sortWithinPartitions("t")
    lists = scratch.save(posted.mapInArrow(_shared_lists, ENTRY_TYPES), "lists")
    stars = scratch.save(lists.repartition("t").sortWithinPartitions("t", F.desc("common"), "sid").mapInArrow(_stars, "a long, b long").distinct(), "stars")
    scratch.drop("signed")
    first = _verify(source, stars, scratch, "stars")
    linked = first.where("linked").select("a", "b")
    comp = scratch.save(components(spark, linked), "star-components")
    grouped, hubs = _within_groups(spark, first, comp, scratch)
    linked = linked.union(grouped)
    comp = scratch.save(components(spark, linked), "group-components")
    known = lists.join(comp, lists["sid"] == comp["id"], "left").join(hubs, "sid", "left")
    known = known.select("t", "sid", "n", "pos", F.coalesce("component", "sid").alias("comp"), F.coalesce("hub", "sid").alias("hub"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = known.repartition("t").sortWithinPartitions("t").mapInArrow(_rest, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    second = _verify(source, scratch.save(left, "rest"), scratch, "rest")
    final = scratch.save(components(spark, linked.union(second.where("linked").select("a", "b"))), "components")
    for name in ("lists", "stars", "rest", "hubs", "hub-components", "group-links", "star-components", "group-components", *[f"{t}-{n}" for t in ("stars", "rest") for n in ("ids", "verified")]):
        scratch.drop(name)
    out = members.join(final, members["sid"] == final["id"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "sid").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have the smallest id of their component, with their own columns; of rows that repeat an id, all."""
    gone = jaccard_components(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("__pf_gone")).distinct()
    gone = F.broadcast(gone) if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else gone
    return docs.join(gone, F.col(id_col) == F.col("__pf_gone"), "left_anti")
