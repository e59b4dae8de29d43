"""BPE encoding and decoding as streaming transducers with bounded lookahead.

A merge list has a sufficient lookahead: how far behind a boundary between tokens bytes can still decide whether it
stays. It follows from the rules alone. Rule j joins u and v; whether v stands there depends on the rules of lower
rank that would join a last part of v to what follows, so that reach(j) = |v| + the greatest reach of those rules,
and no boundary looks farther than the greatest reach of all. The encoder takes text in pieces, cuts it into slices
with an automaton over character classes, merges a window of bytes, and emits the tokens that end before the
lookahead; it keeps that window, and no more, however long a slice is. The decoder takes ids in pieces and keeps
the bytes of an unfinished character.

Special tokens are taken out of the text first, as the library of the file format does. Supported are byte-level
files without normaliser, prefix space, dropout or affixes; others raise.

Defined results: a null text counts as empty and has no tokens; bytes that aren't UTF-8 decode to U+FFFD first;
repeated rows are encoded alike; further columns pass through, and those named like the added ones give way.
"""

from __future__ import annotations

import codecs
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.shipping import ship

from .common import by_bytes, without

#: Characters, or ids, that a transducer takes at once.
PIECE = 1 << 16
#: Bytes that are merged at once beyond the lookahead.
WINDOW = 4096
#: Bytes up to which ranks are searched in a list rather than a heap.
FEW = 40
#: Slices whose tokens a worker remembers, and the longest of them in characters.
CACHED_SLICES, CACHED_CHARS = 250_000, 64
#: Bytes of text that become Python objects at once, if no text is longer.
BATCH_BYTES = 8 << 20

# How the byte-level format cuts texts, and the classes of the runs in it.
SLICE = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
#: Characters behind a cut that decide it: the rest of a contraction.
SLICE_AHEAD = 3


def lookahead(rules: Sequence[tuple[bytes, bytes]]) -> int:
    """The greatest reach of all rules, in bytes: a boundary with as many known bytes behind it is final."""
    made: dict[bytes, tuple[int, bytes]] = {}
    joins: dict[bytes, tuple[list[int], list[int]]] = {}  # by left part: ranks, and the greatest reach up to each
    top = 0
    for rank, (u, v) in enumerate(rules):
        if any(len(x) > 1 and x not in made for x in (u, v)) or u + v in made:
            raise ValueError(f"rule {rank} joins parts that no rule before it makes, or makes a token again")
        extra, last, before = 0, v, rank
        while True:  # the last parts of v, and the rank at which each is used up
            ranks, reaches = joins.get(last, ((), ()))
            if k := bisect_left(ranks, before):
                extra = max(extra, reaches[k - 1])
            if last not in made:
                break
            before, last = made[last]
        ranks, reaches = joins.setdefault(u, ([], []))
        ranks.append(rank)
        reaches.append(max(len(v) + extra, reaches[-1] if reaches else 0))
        made[u + v] = (rank, v)
        top = max(top, len(v) + extra)
    return top


@dataclass
class Model:
    """Bytes of all ids, ids of single bytes, ranks of pairs, the id that each rank makes, special tokens, the lookahead, and the longest token."""

    vocab: list[bytes]
    byte_ids: list[int]
    pairs: dict[tuple[int, int], int]
    makes: list[int]
    special: dict[str, int]
    ahead: int
    longest: int

    @classmethod
    def of(cls, vocab: dict[bytes, int], rules: Sequence[tuple[bytes, bytes]], special: dict[str, int] | None = None) -> Model:
        special = special or {}
        by_id = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
        for raw, i in [*vocab.items(), *((k.encode(), i) for k, i in special.items())]:
            by_id[i] = raw
        pairs = {(vocab[u], vocab[v]): rank for rank, (u, v) in enumerate(rules)}
        return cls(by_id, [vocab[bytes([b])] for b in range(256)], pairs, [vocab[u + v] for u, v in rules], special, lookahead(rules), max(map(len, by_id), default=0))


def byte_letters() -> dict[str, int]:
    """The format writes bytes as letters: the printable ones of Latin-1 as themselves, the others as U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = sorted(set(range(256)) - set(plain))
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


def load(path: str) -> Model:
    """A byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or said.get("normalizer") or odd or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level BPE without normaliser, prefix space, dropout or affixes is supported")
    if any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in white space or whole words only aren't supported")
    letter = byte_letters()
    raw = lambda t: bytes(letter[c] for c in t)
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    return Model.of(vocab, [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])], special)


class Merger:
    """Bytes of one slice in pieces, its token ids out as soon as they are final; holds `ahead` + WINDOW bytes at most."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""
        self.window = max(WINDOW, 1 + model.longest)

    def merged(self, raw: bytes) -> list[int]:
        """Ids of bytes that nothing follows: the pair of least rank first, the leftmost of equals."""
        ids = [self.model.byte_ids[b] for b in raw]
        return self._few(ids) if len(ids) <= FEW else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rank, makes, none = self.model.pairs.get, self.model.makes, len(self.model.makes)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i] = makes[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        pairs, makes, n = self.model.pairs, self.model.makes, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = makes[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := pairs.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def push(self, raw: bytes) -> list[int]:
        out: list[int] = []
        vocab, ahead = self.model.vocab, self.model.ahead
        for at in range(0, len(raw), self.window):
            self.held += raw[at : at + self.window]
            if len(self.held) < self.window + ahead:
                continue
            end = 0
            for t in self.merged(self.held):
                if end + len(vocab[t]) > len(self.held) - ahead:
                    break
                end += len(vocab[t])
                out.append(t)
            self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        """The slice ends here."""
        raw, self.held = self.held, b""
        return self.merged(raw)


class Slices(dict):
    """Token ids of short slices, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.merger = Merger(model)

    def __missing__(self, text: str) -> list[int]:
        ids = [*self.merger.push(text.encode()), *self.merger.end()]
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHED_SLICES:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Text in pieces, token ids out. Holds the end of the last piece that what follows may still change, and the merger's window."""

    def __init__(self, model: Model, slices: Slices | None = None):
        self.slices = Slices(model) if slices is None else slices
        self.merger, self.model = Merger(model), model
        self.special = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        self.longest = max(map(len, model.special), default=1)
        self.raw = ""  # not yet searched for special tokens
        self.held = ""  # not yet cut
        self.run: regex.Pattern | None = None  # the kind of run that a slice under way has

    def push(self, text: str, last: bool = False) -> list[int]:
        """last: nothing follows this piece."""
        out: list[int] = []
        text = self.raw + text
        begin = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self._cut(text[begin : m.start()], True)
            out.append(self.model.special[m[0]])
            begin = m.end()
        upto = len(text) if last else max(begin, len(text) - self.longest + 1)
        self.raw = text[upto:]
        out += self._cut(text[begin:upto], last)
        return out

    def _cut(self, text: str, last: bool) -> list[int]:
        text, self.held = self.held + text, ""
        out: list[int] = []
        if self.run:
            text, some = self._go_on(text, last)
            out += some
        if self.run or not text:
            self.held = text
            return out
        found = SLICE.findall(text)
        if not last:
            done = len(text)
            while found and done > len(text) - SLICE_AHEAD:
                done -= len(found.pop())
            self.held = text[done:]
        out += chain.from_iterable(map(self.slices.__getitem__, found))
        if len(self.held) > PIECE:  # one slice without an end: its bytes go on as they come
            self.run = next(p for p in RUNS if p.match(self.held[1]))
            out += self.merger.push(self.held[:1].encode())
            self.held, some = self._go_on(self.held[1:], False)
            out += some
        return out

    def _go_on(self, text: str, last: bool) -> tuple[str, list[int]]:
        """What the slice under way takes of a text: the rest of the text, and ids."""
        m = self.run.match(text)
        end = m.end() if m else 0
        over = last or end < len(text)
        if self.run is RUNS[3] and end and not (last and end == len(text)):
            end -= 1  # the last white space before a word stands apart or joins it
        out = self.merger.push(text[:end].encode())
        if over:
            self.run = None
            out += self.merger.end()
        return text[end:], out


class Decoder:
    """Token ids in pieces, text out; bytes that aren't UTF-8 become U+FFFD. Holds the bytes of an unfinished character."""

    def __init__(self, model: Model):
        self.vocab, self.state = model.vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Sequence[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.vocab.__getitem__, ids)), last)


_SLICES: dict[tuple[int, int], Slices] = {}


def _pieces(x: Sequence) -> Iterator[tuple[Sequence, bool]]:
    for at in range(0, max(len(x), 1), PIECE):
        yield x[at : at + PIECE], at + PIECE >= len(x)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _map(df: DataFrame, src: DataFrame, keep: list[str], added: dict[str, T.DataType], model: Model, step) -> DataFrame:
    """Rows with further columns that step(slices, batch of src) makes, with the model sent once to each worker."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary, whatever the input
    key = (model.ahead, len(model.vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _SLICES.get(key)
        if slices is None or slices.merger.model != shared.value:
            slices = _SLICES[key] = Slices(shared.value)
        for batch in batches:
            for some, made in step(slices, batch):
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in range(len(keep))], *made], names=[*keep, *added])

    fields = [f for f in src.schema.fields if f.name in keep]
    return src.mapInArrow(run, T.StructType([*fields, *[T.StructField(k, t) for k, t in added.items()]]))


def encode(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds token_ids array<int>. keep: the columns to pass through; all by default. decoded: also add what decode() makes of the ids, in the same worker."""
    ship(df.sparkSession)
    added = {"token_ids": T.ArrayType(T.IntegerType()), **({"decoded": T.StringType()} if decoded else {})}
    text = F.col(f"`{text_col}`").cast("binary").alias("__pf_raw")
    rest = without(df, *added)
    keep = rest.columns if keep is None else [c for c in keep if c in rest.columns]

    def step(slices: Slices, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for some in by_bytes(batch, len(keep), BATCH_BYTES):
            ids, texts = [], []
            for raw in some.column(len(keep)).to_pylist():
                encoder, made = Encoder(slices.merger.model, slices), []
                for piece, last in _pieces((raw or b"").decode("utf-8", "replace")):
                    made.append(np.array(encoder.push(piece, last), np.int32))
                ids.append(np.concatenate(made))
                if decoded:
                    texts.append(_text(slices.merger.model, ids[-1]))
            yield some, [_lists(ids), *([pa.array(texts, pa.string())] if decoded else [])]

    return _map(df, df.select(*[f"`{c}`" for c in keep], text), keep, added, model, step)


def _text(model: Model, ids: np.ndarray) -> str:
    decoder = Decoder(model)
    return "".join(decoder.push(piece.tolist(), last) for piece, last in _pieces(ids))


def decode(df: DataFrame, model: Model, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Adds decoded string, the text of an array of ids; null stays null."""
    ship(df.sparkSession)
    rest = without(df, "decoded")
    keep = rest.columns if keep is None else [c for c in keep if c in rest.columns]

    def step(slices: Slices, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for at in range(0, len(batch), 500):
            some = batch.slice(at, 500)
            lists = (x.values for x in some.column(len(keep)))
            yield some, [pa.array([None if x is None else _text(slices.merger.model, np.asarray(x)) for x in lists], pa.string())]

    src = df.select(*[f"`{c}`" for c in keep], F.col(f"`{ids_col}`").alias("__pf_ids"))
    return _map(df, src, keep, {"decoded": T.StringType()}, model, step)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with token_ids and decoded."""
    return df.withColumns({
        "n_tokens": F.size("token_ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }).drop("token_ids", "decoded")
