"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point gets a class from a table; a small
automaton over the classes decides where a token starts. Its transition functions form a finite monoid,
so that running them is an associative scan over arrays of monoid elements: a table lookup per element.
The slices between boundaries feed a pair merger whose results are cached.

Defined results: a null text counts as empty and has no tokens; bytes that aren't UTF-8 decode to
U+FFFD first; repeated rows are encoded alike; further columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.shipping import ship

from .common import bound_batches, by_bytes, without

#: Code points that are scanned at once, if no text is longer.
SCAN_CHARS = 1 << 20
#: Slices whose merges a worker remembers.
CACHED_SLICES = 250_000

# The White_Space property of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What follows the apostrophe in a contraction.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, END = range(7)  # classes of code points
# Symbols that the automaton reads: a class with what the next characters say.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_SPACE_LAST, S_WHITE, S_WHITE_LAST, S_END = range(10)
# States: at a boundary, within letters / numbers / others, after a space that joins what follows, within
# white space, one / two letters before the end of a contraction.
Q_CUT, Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE, Q_WHITE, Q_ONE, Q_TWO = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110001, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = WHITE
    table[0x20], table[0x27], table[0x110000] = SPACE, APOSTROPHE, END
    return table


def _step(q: int, s: int) -> tuple[bool, int]:
    """Whether a token starts at symbol s, read in state q; the state after it."""
    if s == S_END:
        return True, Q_CUT
    if q in (Q_ONE, Q_TWO):
        return False, Q_CUT if q == Q_ONE else Q_ONE
    if s in (S_LETTER, S_NUMBER, S_OTHER):
        run = (Q_LETTER, Q_NUMBER, Q_OTHER)[s]
        return q not in (run, Q_SPACE), run
    if s in (S_SHORT, S_LONG):
        return (False, Q_OTHER) if q in (Q_OTHER, Q_SPACE) else (True, Q_ONE if s == S_SHORT else Q_TWO)
    if s in (S_SPACE, S_WHITE):
        return q != Q_WHITE, Q_WHITE
    return True, Q_SPACE if s == S_SPACE_LAST else Q_CUT


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element after reading symbol s behind element e, at e * 16 + s; states an element maps to; starts by q * 16 + s)."""
    symbols = [tuple(_step(q, s)[1] for q in range(8)) for s in range(10)]
    elements = {tuple(range(8)): 0}
    table: list[list[int]] = []
    for f in (todo := list(elements)):
        row = []
        for g in symbols:
            h = tuple(g[q] for q in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
            row.append(elements[h])
        table.append(row + [0] * 6)
    starts = np.array([[_step(q, s)[0] for s in range(10)] + [False] * 6 for q in range(8)])
    assert len(table) < 4096
    return np.array(table, np.uint16).ravel(), np.array(list(elements), np.uint8), starts.ravel()


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where tokens start in code points; 0x110000 ends a text and counts as a start of its own."""
    cls = _classes()[points]
    nxt = np.append(cls[1:], END)
    sym = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_OTHER, S_END], np.uint16)[cls]
    last = (nxt != SPACE) & (nxt != WHITE) & (nxt != END)
    sym[(cls == SPACE) & last] = S_SPACE_LAST
    sym[(cls == WHITE) & last] = S_WHITE_LAST
    at = np.flatnonzero(cls == APOSTROPHE)
    if len(at):
        more = np.append(points, [0x110000] * 2)
        one, two = more[at + 1], more[at + 2]
        sym[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = S_SHORT
        for a, b in TWO_LETTERS:
            sym[at[(one == ord(a)) & (two == ord(b))]] = S_LONG
    after, states, starts = _monoid()
    n = len(sym)
    width = max(1, int(n**0.5) // 2)
    rows = -(-n // width)
    grid = np.full(rows * width, S_END, np.uint16)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # each row of the scan is now a column
    before = np.empty_like(grid)
    e = np.zeros(rows, np.uint16)
    for i in range(width):
        before[i] = e
        e = after[(e << 4) | grid[i]]
    q, enter = Q_CUT, np.empty(rows, np.uint8)
    for r, f in enumerate(states[e].tolist()):
        enter[r] = q
        q = f[q]
    state = states.ravel()[(before.astype(np.int32) << 3) | enter]
    return np.flatnonzero(starts[(state.astype(np.uint16) << 4) | grid].T.ravel()[:n])


class Merger(dict):
    """Token ids of a slice's text; merges the pair of least rank first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, text: str) -> tuple[int, ...]:
        if len(self) >= CACHED_SLICES:
            self.clear()
        out = self[text] = self.merge(text.encode())
        return out

    def merge(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if part[i] is not x or j >= n or part[j] is not y:
                continue
            part[i], part[j] = x + y, b""
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := prv[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return tuple(ranks[p] for p in part if p)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank, by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_texts(texts: list[str], merger: Merger) -> list[list[int]]:
    """Token ids of each text."""
    out: list[list[int]] = []
    done = 0
    while done < len(texts):
        last, size = done, 0
        while last < len(texts) and (last == done or size + len(texts[last]) <= SCAN_CHARS):
            size += len(texts[last]) + 1
            last += 1
        some = texts[done:last]
        ends = np.cumsum([len(t) + 1 for t in some])
        points = np.empty(size, np.uint32)
        at = 0
        for t in some:
            points[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            at += len(t) + 1
            points[at - 1] = 0x110000
        cuts = token_starts(points)
        upto = np.searchsorted(cuts, ends - 1)  # the end marker of each text is a start
        begin, shift = 0, 0
        for t, u, e in zip(some, upto.tolist(), ends.tolist(), strict=True):
            c = (cuts[begin : u + 1] - shift).tolist()
            out.append(list(chain.from_iterable(map(merger.__getitem__, [t[a:b] for a, b in zip(c, c[1:], strict=False)]))))
            begin, shift = u + 1, e
        done = last
    return out


class Vocabulary:
    """The bytes of all tokens in one array, and where each token's begin."""

    def __init__(self, ranks: dict[bytes, int]):
        vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            vocab[v] = k
        self.sizes = np.array([len(b) for b in vocab], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(vocab), np.uint8)


def decode_lists(ids: pa.ListArray, offsets: pa.ListArray, vocab: Vocabulary) -> pa.BinaryArray:
    """Each token's bytes, put where its offset says."""
    starts = np.asarray(ids.offsets) - ids.offsets[0].as_py()
    flat = np.asarray(ids.flatten()).astype(np.int64)
    ends_at = np.asarray(offsets.offsets)[1:] - offsets.offsets[0].as_py() - 1
    values = np.asarray(offsets.flatten()).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(values[ends_at])])
    is_end = np.zeros(len(values), bool)
    is_end[ends_at] = True
    at = values[~is_end] + np.repeat(base[:-1], np.diff(starts))
    n = vocab.sizes[flat]
    out = np.empty(int(base[-1]), np.uint8)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at, n) + within] = vocab.pool[np.repeat(vocab.first[flat], n) + within]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(out)])


def encode_lists(texts: list[str], merger: Merger, vocab: Vocabulary) -> tuple[pa.ListArray, pa.ListArray]:
    """Token ids, and the bytes where tokens start; the last offset is the text's size."""
    ids = encode_texts(texts, merger)
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(vocab.sizes[flat])])
    at = np.repeat(ends[:-1] + np.arange(len(ids)), counts) + (np.arange(len(flat)) - np.repeat(ends[:-1], counts))
    offsets = np.empty(len(flat) + len(ids), np.int32)
    offsets[at] = total[:-1] - np.repeat(total[ends[:-1]], counts)
    offsets[ends[1:] + np.arange(len(ids))] = total[ends[1:]] - total[ends[:-1]]
    lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in ((ends, flat), (ends + np.arange(len(ends)), offsets))]
    return lists[0], lists[1]


#: Bytes of texts that become Python objects at once, unless one text has more; encoding and decoding take up to some seventy times as many, where each byte is a token.
BATCH_BYTES = 1 << 20
_MERGERS: dict[int, Merger] = {}


def coded(batches: Iterator[pa.RecordBatch], text: int, merger: Merger, vocab: Vocabulary, decoded: bool) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Slices of the batches, and what is added to each. text: the column of raw texts."""
    for batch in (some for whole in batches for some in by_bytes(whole, text, BATCH_BYTES)):
        ids, offsets = encode_lists([(b or b"").decode("utf-8", "replace") for b in batch.column(text).to_pylist()], merger, vocab)
        yield batch, [ids, offsets, *([decode_lists(ids, offsets, vocab)] if decoded else [])]


def encode(df: DataFrame, ranks: dict[bytes, int], text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds token_ids array<int> and token_offsets array<int>, the byte where each token starts and, last, the text's size.

    keep: the columns to pass through; all by default. decoded: also add what decode() makes of the ids, in the same worker.
    """
    ship(spark := df.sparkSession)
    bound_batches(spark)
    df = without(df, "token_ids", "token_offsets", *["decoded"] * decoded)
    keep = df.columns if keep is None else [c for c in keep if c in df.columns]
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the input
    src = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__pf_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.setdefault(len(shared.value), Merger(shared.value))
        if merger.ranks != shared.value:
            merger = _MERGERS[len(shared.value)] = Merger(shared.value)
        for batch, made in coded(batches, len(keep), merger, Vocabulary(shared.value), decoded):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(keep))], *made], names=[*keep, *added])

    ints = T.ArrayType(T.IntegerType())
    kinds = {"token_ids": ints, "token_offsets": ints, **({"decoded": T.BinaryType()} if decoded else {})}
    added = list(kinds)
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], *[T.StructField(k, t) for k, t in kinds.items()]]))


def decode(df: DataFrame, ranks: dict[bytes, int], keep: list[str] | None = None) -> DataFrame:
    """Adds decoded binary to rows with the columns that encode() adds."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    df = without(df, "decoded")
    keep = df.columns if keep is None else [c for c in keep if c in df.columns]
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    src = df.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "token_ids", "token_offsets"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(shared.value)
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, len(whole), 500)):
            made = decode_lists(batch.column("token_ids"), batch.column("token_offsets"), vocab)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], names=[*keep, "decoded"])

    return src.mapInArrow(run, T.StructType([*[f for f in src.schema.fields if f.name in keep], T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with token_ids and decoded."""
    return df.withColumns({
        "n_tokens": F.size("token_ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("token_ids", "token_offsets", "decoded")
