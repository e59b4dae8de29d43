"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which is linear in the words of a
text. x holds the hashed words, logarithms of their counts scaled to length 1, and a few standardised numbers
about structure and length. Whole texts are read; language, source, id and labels are never inputs.

Defined results: null and empty texts are scored, by structure alone; repeated rows score alike; an empty
table gives no rows; further columns pass through. Labels that are null or whose row is missing aren't learnt;
a document with several labels counts with the least of them, and an id with several texts with one of them, the least by hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.shipping import ship

from .common import bound_batches, by_bytes, without

#: Hash buckets of words, factors, and labelled rows that are learnt at most.
BUCKETS, RANK, FIT_ROWS = 8192, 8, 8000
#: Words whose bucket a worker remembers.
CACHED_WORDS = 100_000
#: Bytes of texts that become Python objects at once, unless one text has more.
BATCH_BYTES = 1 << 20
STRUCTURE = ("log_words", "log_chars", "word_length", "distinct_share", "top_share", "upper_share", "digit_share", "mark_share", "wide_share", "line_words", "bar_share", "marked_word_share", "again_share")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
_UPPER, _DIGIT, _WIDE = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))
_TAIL = re.compile(r"[^\w\s.,]+(?=\s|$)")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return out


_BUCKETS = _Buckets()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets, their values, and the numbers named in STRUCTURE."""
    text = text or ""
    words = text.split()
    counts, n = Counter(words), len(words)
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    share = lambda those: (size - len(raw.translate(None, those))) / max(size, 1)
    numbers = [
        np.log1p(n), np.log1p(size), len(text) / max(n, 1), len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        share(_UPPER), share(_DIGIT), share(_MARKS), share(_WIDE), np.log1p(n / (text.count("\n") + 1)), text.count("|") / max(n, 1), len(_TAIL.findall(text)) / max(n, 1), sum(map(eq, words, words[1:])) / max(n, 1),
    ]
    idx = np.fromiter(map(_BUCKETS.__getitem__, counts), np.int32, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return idx, val / max(float(np.sqrt((val * val).sum())), 1e-9), numbers


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def scaled(self, numbers: np.ndarray) -> np.ndarray:
        return np.clip((numbers - self.mean) / self.sd, -4, 4).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Linear in the words: three sums over the entries of each row."""
        out = np.empty(len(texts))
        own = slice(BUCKETS, None)
        for i, t in enumerate(texts):
            idx, val, numbers = features(t)
            z = self.scaled(np.array(numbers))
            vx = self.v[idx] * val[:, None]
            vz = self.v[own] * z[:, None]
            total = vx.sum(0) + vz.sum(0)
            squares = (vx * vx).sum() + (vz * vz).sum()
            out[i] = self.bias + self.w[idx] @ val + self.w[own] @ z + 0.5 * (float(total @ total) - float(squares))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def learn(rows: list[tuple[np.ndarray, np.ndarray, list[float], int]], epochs: int = 8, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Minimises the logarithmic loss with AdaGrad over dense batches; one class only, or no rows, gives a constant."""
    m = BUCKETS + len(STRUCTURE)
    numbers = np.array([r[2] for r in rows], float).reshape(-1, len(STRUCTURE))
    y = np.array([r[3] for r in rows], np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    fm = Machine(float(np.log(share / (1 - share))), np.zeros(m, np.float32), np.zeros((m, RANK), np.float32), numbers.mean(0) if rows else np.zeros(len(STRUCTURE)), numbers.std(0) + 1e-6 if rows else np.ones(len(STRUCTURE)))
    if len(set(y.tolist())) < 2:
        return fm
    rng = np.random.default_rng(seed)
    fm.v = rng.normal(0, 0.05, (m, RANK)).astype(np.float32)
    gw, gv, gb = np.full(m, 1e-3, np.float32), np.full((m, RANK), 1e-3, np.float32), 1e-3
    z = fm.scaled(numbers)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = order[at : at + batch]
            x = np.zeros((len(some), m), np.float32)
            for i, r in enumerate(some):
                np.add.at(x[i], rows[r][0], rows[r][1])
            x[:, BUCKETS:] = z[some]
            xv, x2 = x @ fm.v, x * x
            p = 1 / (1 + np.exp(-np.clip(fm.bias + x @ fm.w + 0.5 * ((xv * xv).sum(1) - (x2 @ (fm.v * fm.v)).sum(1)), -30, 30)))
            g = ((p - y[some]) / len(some)).astype(np.float32)
            dw = x.T @ g + decay * fm.w
            dv = x.T @ (g[:, None] * xv) - fm.v * (x2.T @ g)[:, None] + decay * fm.v
            gw += dw * dw
            gv += dv * dv
            gb += float(g.sum()) ** 2
            fm.w -= rate * dw / np.sqrt(gw)
            fm.v -= rate * dv / np.sqrt(gv)
            fm.bias -= rate * float(g.sum()) / gb**0.5
    return fm


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Learns from at most fit_rows labelled documents, the first by a hash of their ids.

    Only their features come to the driver. The labels are joined by broadcast, since their number is bounded.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    met = docs.select(F.col(f"`{id_col}`").alias("_of"), F.col(f"`{text_col}`").alias("_t")).join(F.broadcast(known), F.col("_of") == F.col("_id"))
    some = met.groupBy("_id").agg(F.min("_y").alias("_y"), F.min_by("_t", F.struct(F.xxhash64("_t"), F.length("_t"))).alias("_t"))  # fit_rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [features(t) for t in b["_t"]]
            yield pd.DataFrame({"id": b["_id"].astype(str), "y": b["_y"], "idx": [r[0].tobytes() for r in rows], "val": [r[1].tobytes() for r in rows], "numbers": [np.array(r[2]).tobytes() for r in rows]})

    got = sorted(some.mapInPandas(run, "id string, y int, idx binary, val binary, numbers binary").collect(), key=lambda r: (len(r["id"]), r["id"]))
    return learn([(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32), np.frombuffer(r["numbers"]).tolist(), r["y"]) for r in got])


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Adds score double and predicted int. The machine, of fixed size, is broadcast."""
    docs = without(docs, "score", "predicted")
    keep = docs.columns if keep is None else [c for c in keep if c in docs.columns]
    return _scored(docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])]), machine, [text_col], keep, threshold)


def _scored(src: DataFrame, machine: Machine, text: list[str], keep: list[str], threshold: float) -> DataFrame:
    """The columns keep, with which src begins, score and predicted. text: the column of texts, or the path to it in a struct, so that no text goes to the workers twice."""
    ship(src.sparkSession)
    bound_batches(src.sparkSession)
    shared = src.sparkSession.sparkContext.broadcast(machine)
    path = [src.columns.index(text[0]), *[[n.lower() for n in src.schema[text[0]].dataType.names].index(c.lower()) for c in text[1:]]]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            texts = whole.column(path[0])
            for i in path[1:]:
                texts = texts.field(i)
            both = pa.RecordBatch.from_arrays([*[whole.column(i) for i in range(len(keep))], texts], names=[*keep, "__pf_text"])
            for b in by_bytes(both, len(keep), BATCH_BYTES):
                s = shared.value.score(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[: len(keep)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def accept(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    machine = fit(docs, labels, text_col=text_col)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return _scored(rows, machine, ["row", text_col], ["row"], threshold).where("predicted = 1").select("row.*")
