"""Exact top-k by block-at-a-time pruning.

Vectors are quantised to floor(scale * x); a component is a term. Centres, found in a bounded sample, deal the
vectors out to cells; vectors in the order of their cells form blocks, each with a forward index (its vectors as a
matrix) and, beside it, the extremes of every term. For a query, the sum of its term maxima bounds the scores in a block. The
query's k-th score in the sample is where its bound for pruning starts; each task that holds blocks opens them
in the order of their bounds until these fall below the k-th score so far, and the k best of all tasks meet per query.
Only blocks' stored extremes are looked at for every query; a matrix is decoded once, when the first query needs it.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of unlike
length compare as if filled up with zeros; rows that repeat an id are candidates each, but none for that id, which is one
query, with the least of its vectors; null ids take no part; ties go to the smaller id; an empty table gives no
rows; further columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors in a block, rows of the sample, centres at most, and queries that are broadcast at once (32 MB at 1,024 components).
BLOCK, SAMPLE, CENTRES, CHUNK = 256, 4096, 256, 4096
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min
SEED = 3


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, q array<long>), a row for each row that takes part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("q"))


def filled(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, in floating point where that is exact; of unlike widths, over the common one."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * w
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < EXACT else a @ b.T


def find_centres(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Centres of the sample's rows by Lloyd's rounds."""
    n = min(CENTRES, max(1, len(sample) // 8))
    x = sample.astype(float)
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:n]]
    for _ in range(rounds if len(x) else 0):
        own = nearest(centres, x)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=n)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    w = min(centres.shape[1], x.shape[1])
    return np.argmax(x[:, :w] @ centres[:, :w].T - (centres * centres).sum(1) / 2, axis=1)


def block_bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sum of term maxima by query and block: no score in the block is larger."""
    return products(np.maximum(queries, 0), top) + products(np.minimum(queries, 0), low)


class Best:
    """The k best of each query so far; scores of `floor` and more are of use."""

    def __init__(self, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.qids, self.queries, self.floor, self.k = qids, queries, floor.copy(), k
        self.score = np.full((len(qids), k), NONE, np.int64)
        self.id = np.full((len(qids), k), np.iinfo(np.int64).max, np.int64)
        self.read = self.skipped = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        score = products(self.queries[who], rows)
        own = (self.qids[who][:, None] == ids[None]) | (score < self.floor[who][:, None])
        score[own] = NONE
        all_ = np.concatenate([self.score[who], score], 1)
        all_id = np.concatenate([self.id[who], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, own.shape))], 1)
        at = np.lexsort((all_id, -np.maximum(all_, NONE + 1)), axis=1)[:, : self.k]
        self.score[who], self.id[who] = np.take_along_axis(all_, at, 1), np.take_along_axis(all_id, at, 1)
        self.floor[who] = np.maximum(self.floor[who], self.score[who, -1])

    def search(self, blocks: Callable[[int], tuple[np.ndarray, np.ndarray]], top: np.ndarray, low: np.ndarray) -> None:
        """blocks(b): ids and rows of a block. Each query reads its blocks in the order of their bounds."""
        bound = block_bounds(self.queries, top, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        each = np.arange(len(self.qids))
        for r in range(len(top)):
            mine = order[:, r]
            live = np.flatnonzero(bound[each, mine] >= self.floor)
            if not len(live):
                self.skipped += (len(top) - r) * len(each)
                return
            self.read += len(live)
            self.skipped += len(each) - len(live)
            for b in np.unique(mine[live]):
                self.meet(*blocks(b), live[mine[live] == b])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.score != NONE)
        return self.qids[q], self.id[q, j], self.score[q, j]


def sample_floor(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the sample's rows, or the least number: the k-th of all rows isn't below it."""
    best = Best(qids, queries, np.full(len(qids), NONE, np.int64), k)
    if len(ids):
        best.meet(ids, rows, np.arange(len(qids)))
    return best.score[:, -1]


def build_blocks(rows: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """(n, wide, ids, mat, top, low): a row for each block. Rows are sorted by cell, the cell that comes second, and id, over ranges of these."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            x = filled(b["q"].tolist(), max(b["q"].map(len).max(), 1))
            w = min(c.shape[1], x.shape[1])
            fit = x[:, :w].astype(float) @ c[:, :w].T - (c * c).sum(1) / 2
            first = np.argmax(fit, axis=1)
            fit[np.arange(len(fit)), first] = -np.inf
            yield pd.DataFrame({"cell": first, "next": np.argmax(fit, axis=1), "id": b["id"], "x": [np.trim_zeros(v, "b").tobytes() for v in x]})

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for _, some in b.groupby((b["cell"] != b["cell"].shift()).cumsum(), sort=False):
                if held and held[0]["cell"].iloc[0] != some["cell"].iloc[0]:
                    yield block(held)
                    held = []
                while len(some):
                    room = BLOCK - sum(map(len, held))
                    held.append(some.iloc[:room])
                    some = some.iloc[room:]
                    if sum(map(len, held)) == BLOCK:
                        yield block(held)
                        held = []
        if held:
            yield block(held)

    def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(parts)
        lists = [np.frombuffer(v, np.int64) for v in whole["x"]]
        mat = filled(lists, max(1, max(map(len, lists))))
        kind = np.int32 if np.abs(mat).max(initial=0) < 1 << 31 else np.int64
        ends = {"top": [mat.max(axis=0).astype(kind).tobytes()], "low": [mat.min(axis=0).astype(kind).tobytes()]}
        return pd.DataFrame({"n": [len(whole)], "wide": [kind is np.int64], "ids": [whole["id"].to_numpy(np.int64).tobytes()], "mat": [mat.astype(kind).tobytes()], **ends})

    placed = rows.mapInPandas(place, "cell int, next int, id long, x binary")
    return placed.repartitionByRange("cell", "next", "id").sortWithinPartitions("cell", "next", "id").mapInPandas(chunk, "n int, wide boolean, ids binary, mat binary, top binary, low binary")


def numbers(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if wide else np.int32).astype(np.int64)


class Opened:
    """The blocks of a batch; ids and matrices are decoded when they are asked for, and kept while the batch lasts."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.kept = batch, {}
        self.wide = batch.column("wide").to_pylist()

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and the least of each term by block."""
        top, low = ([numbers(x, w) for x, w in zip(self.batch.column(c).to_pylist(), self.wide, strict=True)] for c in ("top", "low"))
        width = max(map(len, top))
        return filled(top, width), filled(low, width)

    def __call__(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.kept:
            ids = np.frombuffer(self.batch.column("ids")[b].as_py(), np.int64)
            self.kept[b] = ids, numbers(self.batch.column("mat")[b].as_py(), self.wide[b]).reshape(len(ids), -1)
        return self.kept[b]


#: Blocks whose bounds are compared at once.
AT_ONCE = 64


def top_k(vectors: DataFrame, is_query: Callable, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", tell: Callable | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ids of which is_query(id) holds, against all rows.

    Queries are broadcast in chunks of a fixed number, each of which passes over the blocks once. tell: is given
    accumulators for pairs of a query and a block that were scored and that were skipped, and for blocks that were opened and that no query needed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    rows = scratch.save(quantised(vectors, id_col, vec_col, scale), "rows")
    width = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1)
    sample = rows.orderBy(F.xxhash64("id", "q"), "id").limit(SAMPLE).collect()
    sample_ids, sample_rows = np.array([r["id"] for r in sample], np.int64), filled([r["q"] for r in sample], width)
    centres = find_centres(sample_rows) if len(sample) else np.zeros((1, width))
    blocks = scratch.save(build_blocks(rows, centres, width), "blocks")
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("q").alias("q"))
    chunks = max(1, -(-queries.count() // CHUNK))
    queries = scratch.save(queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "queries")
    read, skipped, opened, left = (spark.sparkContext.accumulator(0) for _ in range(4))

    def searched(c: int) -> DataFrame:
        asked = queries.where(F.col("chunk") == c).collect()  # about CHUNK rows
        qids, q = np.array([r["id"] for r in asked], np.int64), filled([r["q"] for r in asked], width)
        shared = spark.sparkContext.broadcast((qids, q, sample_floor(qids, q, sample_ids, sample_rows, k)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k)
            for b in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, len(whole), AT_ONCE)):
                some = Opened(b)
                best.search(some, *some.ends())
                opened.add(len(some.kept))
                left.add(len(b) - len(some.kept))
            read.add(best.read)
            skipped.add(best.skipped)
            qid, vid, score = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(score)], names=["query_id", "vec_id", "score"])

        return blocks.mapInArrow(run, "query_id long, vec_id long, score long")

    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda part: part.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if tell:
        tell(read, skipped, opened, left)
    if chunks == 1:
        return ranked(searched(0))
    for c in range(chunks):  # a chunk's queries and results are written before the next is broadcast
        ranked(searched(c)).write.parquet(f"{scratch.root}/found/chunk={c}")
    return spark.read.parquet(f"{scratch.root}/found").select("query_id", "rank", "vec_id", "score")
