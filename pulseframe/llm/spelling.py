"""Groups of spelling variants: each word's neighbours by one edit, and the commoner form that it stands for.

Every word emits its full neighbourhood: all distinct results of one deletion, replacement or insertion over the
letters that the vocabulary holds. A hash join with the vocabulary leaves those that are words, so that no distance
is ever computed. A word of l letters emits some 2 l times the alphabet's size, whatever the corpus, so candidates
are first held against a Bloom filter of the vocabulary, as hashes that each edit changes by a few terms; only those
that pass become strings and are shuffled to the join, which decides. The filter has sixteen bits a word up to a
fixed size; of larger vocabularies more candidates pass it, none is lost.

Defined results: null and empty texts have no words; a null id counts as the empty string where ids are hashed;
repeated rows count each time; of equally frequent neighbours the first in code-point order is the form; further
columns are left out, as the rows are words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The letters of a run, and those that are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
#: Bits of the filter at most (32 MB), bits a word below that, and bits that each word sets.
MOST_BITS, BITS_A_WORD, SETS = 1 << 28, 16, 4
#: Candidates that are hashed at once.
AT_ONCE = 1 << 17
#: Base of the polynomial hash, odd, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters with `least` code points or more, A-Z lower-cased."""
    low = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    found = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """word: the run, less one code point where `every` divides the crc32 of id:run; for testing on texts without misspellings."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    slipped = F.expr("concat(substring(run, 1, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least: int = 6, at_least: int = 5) -> DataFrame:
    """(word, n): words of `least` code points or more that occur `at_least` times or more."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


@dataclass
class Hashes:
    """Polynomial hashes of words over an alphabet, and of all words one edit away."""

    letters: str  # by code point

    def __post_init__(self) -> None:
        self.points = np.array([ord(c) for c in self.letters], np.uint32)
        self.values = _mixed(np.arange(1, len(self.points) + 1, dtype=np.uint64) * np.uint64(BASE))

    def codes(self, words: list[str]) -> np.ndarray:
        """Letter numbers of words of one length, a row each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return np.searchsorted(self.points, points).reshape(len(words), -1)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of each letter's term before every place, those from it on, and the powers of the base."""
        power = np.cumprod(np.append(np.uint64(1), np.full(codes.shape[1], BASE, np.uint64)))
        before = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(self.values[codes] * power[:-1], axis=1, out=before[:, 1:])
        return before, before[:, -1:] - before, power

    def edits(self, codes: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Kind, hashes by word, place (and letter), and which of them stand: edits within a row of equal letters count once."""
        before, behind, power = self.of(codes)
        letter, base = np.arange(len(self.values)), np.uint64(BASE)
        terms = self.values * power[:, None]
        own, was = codes[:, :, None], np.concatenate([np.full((len(codes), 1), -1), codes], axis=1)
        yield "insert", (before + behind * base)[:, :, None] + terms, was[:, :, None] != letter
        yield "replace", (before[:, :-1] + behind[:, 1:])[:, :, None] + terms[:-1], own != letter
        yield "delete", before[:, :-1] + behind[:, 1:] * np.uint64(BACK), codes != was[:, :-1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _places(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th bit that a mixed hash sets in a filter of 2^n bits."""
    return (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _by_length(words: list[str], cells: int) -> Iterator[np.ndarray]:
    """Numbers of words of equal length, few enough for AT_ONCE cells at `cells` a letter, one at least."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, AT_ONCE // ((n + 1) * cells))
        yield from (at[k : k + step] for k in range(0, len(at), step))


def bloom(vocab: DataFrame, letters: str, bits: int) -> np.ndarray:
    """The filter's bytes; words set their bits in parts, which are aggregated before they come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(letters)
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in _by_length(words, 1):
                h = _mixed(hashes.of(hashes.codes([words[i] for i in at]))[0][:, -1])
                where = np.concatenate([_places(h, bits, k) for k in range(SETS)])
                one = np.uint64(1) << (where & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((where >> np.uint64(6)).astype(np.int64)), pa.array(one.view(np.int64))], names=["cell", "bits"])

    cells = vocab.select("word").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint8)


def neighbourhood(vocab: DataFrame, letters: str) -> DataFrame:
    """(word, n, near): the distinct strings one edit away that may be in the vocabulary; all that are, and few others."""
    bits = 64
    while bits < min(MOST_BITS, BITS_A_WORD * vocab.count()):
        bits *= 2
    shared = vocab.sparkSession.sparkContext.broadcast(bloom(vocab, letters, bits))  # MOST_BITS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filled = Hashes(letters), shared.value

        def passes(h: np.ndarray, k: int) -> np.ndarray:
            at = _places(h, bits, k)
            return (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            words = batch.column(0).to_pylist()
            row, near = [], []
            for some in _by_length(words, len(letters)):
                for kind, h, stands in hashes.edits(hashes.codes([words[i] for i in some])):
                    h = _mixed(h)
                    at = np.flatnonzero(stands & passes(h, 0))
                    left = h.ravel()[at]
                    for k in range(1, SETS):
                        on = passes(left, k)
                        at, left = at[on], left[on]
                    index = [x.tolist() for x in np.unravel_index(at, h.shape)]
                    rows = some[index[0]].tolist()
                    row += rows
                    if kind == "delete":
                        near += [words[w][:i] + words[w][i + 1 :] for w, i in zip(rows, index[1], strict=True)]
                    else:
                        skip = kind == "replace"
                        near += [words[w][:i] + letters[c] + words[w][i + skip :] for w, i, c in zip(rows, *index[1:], strict=True)]
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(near, pa.string())], names=["word", "n", "near"])

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, near string")


def variants(words: DataFrame, least: int = 6, at_least: int = 5, ratio: int = 5) -> DataFrame:
    """Per word: form and root string, n, n_near and form_n long. words: one row an occurrence.

    form: the word one edit away that occurs most, if `ratio` times as often or more. root: the last form of forms.
    """
    spark = words.sparkSession
    scratch = Scratch(spark, "spelling")
    vocab = scratch.save(vocabulary(words, least, at_least), "vocabulary")
    letters = "".join(sorted(r[0] for r in vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()))  # as many as the pattern has at most
    met = neighbourhood(vocab, letters).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("b"))
    best = best.select("word", "n_near", F.col("b.near").alias("form"), (-F.col("b.col1")).alias("form_n"))
    known = vocab.join(best, "word", "left").withColumn("holds", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    known = scratch.save(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(holds, form, null)").alias("form"), F.expr("if(holds, form_n, null)").alias("form_n")),
        "forms",
    )
    return known.join(roots(scratch, known.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: a chain of k forms ends after log2 k rounds, and counts grow `ratio` times with each form."""
    at, k = scratch.save(forms.withColumnRenamed("form", "root"), "roots-0"), 0
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        k += 1
        at = scratch.save(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{k}")
