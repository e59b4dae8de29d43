"""Periodic runs of words: stretches that repeat with a period, found in the suffix tree of each text.

The tree of a batch of texts is held as arrays: suffixes in order (prefix doubling that sorts again only what is
still tied), the number of words that neighbours share, and from it the two halves that each node parts. Words
carry their text's number, so that no node spans two texts. At a node of depth q every leaf i of the smaller half
is looked up: if i + q or i - q lies in the other half, a tandem repeat of period q branches there. A run holds
one branching repeat of its period, at its right end; turning that one to the left, word by word, as long as words
q apart agree gives the run, and repeats of multiples of the period at the same end merge into it.

Defined results: a null text has no words, no runs and an empty collapsed text; repeated rows are handled alike;
words are told apart by their bytes; further columns pass through, and those named like the added ones give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.shipping import ship

from .common import by_bytes, without

#: Bytes of text whose suffixes are sorted at once, if no text is longer.
BATCH_BYTES = 2 << 20
#: Leaves that are looked up at once, and cells of a block of comparisons.
AT_ONCE = 1 << 20
#: Rounds of pointer jumping before bounds are searched in a table of minima.
JUMPS = 12
#: Stands for a number of shared words above all limits.
MANY = np.iinfo(np.int32).max


def _order(word: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, each one's rank, and the words shared with the suffix before; more than limit counts as any number above it."""
    n = len(word)
    order = np.argsort(word)
    sorted_ = word[order]
    head = np.empty(n, bool)
    head[0], head[1:] = True, sorted_[1:] != sorted_[:-1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    parted = np.where(head, 0, -1).astype(np.int8)  # the level at which a suffix parts from the one before
    levels, h = [rank.copy()], 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    at = np.flatnonzero(tied)
    while len(at := at[limit[order[at]] >= h]):
        s = order[at]
        key = (rank[s].astype(np.int64) << 32) | (rank[np.minimum(s + h, n)] + 1)
        o = np.argsort(key)
        key = key[o]
        order[at] = s[o]
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        parted[at[new & (parted[at] < 0)]] = len(levels)
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank.copy())
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, h = at[tied], 2 * h
    shared = np.where(parted < 0, MANY, 0).astype(np.int64)
    at = np.flatnonzero(parted > 0)
    size = np.left_shift(1, parted[at].astype(np.int64) - 1)
    left, right = order[at - 1] + size, order[at] + size
    for b in range(len(levels) - 3, -1, -1):
        few = np.flatnonzero(parted[at] >= b + 2)
        few = few[levels[b][left[few]] == levels[b][right[few]]]
        size[few] += 1 << b
        left[few] += 1 << b
        right[few] += 1 << b
    shared[at] = size
    return order, rank, shared


def _less_behind(shared: np.ndarray) -> np.ndarray:
    """For each place, the nearest one behind it at which fewer words are shared; at place 0 none are. Only where 0 < shared < MANY."""
    n = len(shared)
    to = np.arange(n) - 1
    own = np.flatnonzero(shared)
    for _ in range(JUMPS):
        c = to[own]
        on = shared[c] >= shared[own]
        own, c = own[on], c[on]
        if not len(own):
            return to
        to[own] = to[c]
    own = own[shared[own] < MANY]
    table = [shared]  # least value of the 2^b places up to each
    while 2 << len(table) <= n:
        w = 1 << (len(table) - 1)
        table.append(np.concatenate([table[-1][:w], np.minimum(table[-1][w:], table[-1][:-w])]))
    for b in range(len(table) - 1, -1, -1):
        c = to[own]
        to[own] = np.where((c >> b > 0) & (table[b][c] >= shared[own]), c - (1 << b), c)
    return to


def branching_repeats(word: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last words and periods of all branching tandem repeats, of periods up to the limit at their place."""
    order, rank, shared = _order(word, limit)
    node = np.flatnonzero(shared > 0)
    node = node[shared[node] <= limit[order[node]]]
    low = _less_behind(shared)[node]
    high = len(word) - _less_behind(np.append(shared, 0)[::-1])[len(word) - node]
    o = np.lexsort((node, shared[node], low))  # places of one node of the tree: each parts what is behind it from the child ahead
    twin = (low[o[1:]] == low[o[:-1]]) & (shared[node[o[1:]]] == shared[node[o[:-1]]])
    high[o[:-1][twin]] = node[o[1:][twin]]
    small_left = node - low <= high - node
    first, after = np.where(small_left, low, node), np.where(small_left, node, high)
    other, other_after = np.where(small_left, node, low), np.where(small_left, high, node)
    depth, done = shared[node], np.concatenate([[0], np.cumsum(after - first)])
    ends, periods = [], []
    k = 0
    while k < len(node):
        upto = max(k + 1, int(np.searchsorted(done, done[k] + AT_ONCE, "right")) - 1)
        of = np.repeat(np.arange(k, upto), (after - first)[k:upto])
        i = order[first[of] + np.arange(len(of)) - (done[of] - done[k])]
        q = depth[of]
        for j, begin in ((i + q, i), (i - q, i - q)):
            r = rank[np.where((j >= 0) & (j < len(word)), j, len(word))]
            hit = (r >= other[of]) & (r < other_after[of])
            ends.append(begin[hit] + 2 * q[hit] - 1)
            periods.append(q[hit])
        k = upto
    return np.concatenate([[], *ends]).astype(np.int64), np.concatenate([[], *periods]).astype(np.int64)


def _turned(word: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words from `at` backwards equal the word q after them."""
    n, rows, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while len(rows):
        on = []
        for some in np.array_split(rows, -(-len(rows) * width // AT_ONCE)):
            x = (at[some] - n[some])[:, None] - np.arange(width)
            inside = np.maximum(x, 0)
            same = (x >= 0) & (word[inside] == word[inside + q[some][:, None]])
            all_ = same.all(1)
            n[some] += np.where(all_, width, same.argmin(1))
            on.append(some[all_])
        rows, width = np.concatenate(on), min(4 * width, 4096)
    return n


def maximal_runs(word: np.ndarray, text: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of word numbers, by start and period. text: each word's text, ascending."""
    if not len(word):
        return (np.zeros(0, np.int64),) * 3
    word = (text.astype(np.int64) << 32) | word
    limit = np.bincount(text)[text] // min_exponent  # a longer period has no room
    end, q = branching_repeats(word, limit)
    o = np.lexsort((q, end))
    end, q = end[o], q[o]
    found = []
    while len(end):
        head = np.concatenate([[True], end[1:] != end[:-1]])
        e, p = end[head], q[head]
        length = 2 * p + _turned(word, e - 2 * p, p)
        found.append((e - length + 1, length, p))
        of = np.cumsum(head) - 1
        rest = ~head & ((q % p[of] != 0) | (2 * q > length[of]))
        end, q = end[rest], q[rest]
    start, length, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    good = length >= np.maximum(min_length, min_exponent * p)
    start, length, p = start[good], length[good], p[good]
    o = np.lexsort((p, start))
    return start[o], length[o], p[o]


def _batch(texts: list[bytes | None], min_length: int, min_exponent: int) -> list[pa.Array]:
    """n_words, runs and collapsed of some texts."""
    lists = [(t or b"").split() for t in texts]  # ASCII white space only, as these are bytes
    sizes = np.array([len(x) for x in lists])
    first = np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = {}
    word = np.fromiter(map(numbers.setdefault, chain.from_iterable(lists), count()), np.int64, int(first[-1]))
    text = np.repeat(np.arange(len(texts)), sizes)
    start, length, q = maximal_runs(word, text, min_length, min_exponent)
    of = text[start]
    depth = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(depth, start + q, 1)
    np.add.at(depth, start + length, -1)
    gone = np.cumsum(depth[:-1]) > 0
    collapsed = [b" ".join(x) for x in lists]
    for k in np.unique(of).tolist():
        collapsed[k] = b" ".join([w for w, g in zip(lists[k], gone[first[k] : first[k + 1]].tolist(), strict=True) if not g])
    n = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(q)], ["start", "length", "period"])
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(n), runs), pa.array(collapsed, pa.binary())]


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "collapsed": T.BinaryType()}


def find_runs(df: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, runs array<struct<start, length, period>> by start and period, and collapsed string.

    A run is a stretch of words with smallest period q, as long as min_length and min_exponent * q at least, that no
    neighbour extends. collapsed: the text without what runs repeat after their first period, words joined by one
    space. keep: the columns to pass through; all by default.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("binary").alias("__pf_raw")
    kept = without(df, *ADDED)
    keep = kept.columns if keep is None else [c for c in keep if c in kept.columns]
    src = df.select(*[f"`{c}`" for c in keep], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in by_bytes(whole, len(keep), BATCH_BYTES)):
            made = _batch(batch.column(len(keep)).to_pylist(), min_length, min_exponent)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(keep))], *made], names=[*keep, *ADDED])

    out = src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], *[T.StructField(k, t) for k, t in ADDED.items()]]))
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: F.Column) -> F.Column:
    """The run of greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def digests(df: DataFrame) -> DataFrame:
    """n_runs, the strongest run's start, length, period and exponent_milli, and digests of runs and collapsed."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return df.withColumn("__pf_best", best).withColumns({
        "n_runs": F.size("runs").cast("long"),
        "start": F.col("__pf_best.start"), "length": F.col("__pf_best.length"), "period": F.col("__pf_best.period"),
        "exponent_milli": F.expr("1000 * __pf_best.length div __pf_best.period"),
        "runs_sha256": F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256),
        "collapsed_sha256": F.sha2(F.col("collapsed").cast("binary"), 256),
    }).drop("__pf_best")


def plant(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replaces the texts of a tenth of ids, by crc32 of the id, from a word on by repetitions of what follows there; the others stay."""
    blank = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, blank), lambda w: w != "")
    made = F.expr("""array_join(transform(__pf_words, (w, i) -> if(i < __pf_a, w, element_at(__pf_words, cast(__pf_a + (i - __pf_a) % __pf_p + 1 as int)))), ' ')""")
    g, n = F.expr("__pf_h div 10"), F.size("__pf_words")
    return (
        df.withColumn("__pf_h", h)
        .withColumn("__pf_words", F.when(F.col("__pf_h") % 10 == 0, words))
        .withColumn("__pf_a", F.when(n > 0, g % n))
        .withColumn("__pf_p", F.expr("1 + (size(__pf_words) - __pf_a) div (3 + (__pf_h div 10) % 8)"))
        .withColumn(text_col, F.when(F.col("__pf_a").isNotNull(), made).otherwise(F.col(text_col)))
        .drop("__pf_h", "__pf_words", "__pf_a", "__pf_p")
    )
