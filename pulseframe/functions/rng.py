"""A portable 32-bit xorshift generator as folds over columns, so that any engine reproduces a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295
# Fixed value: what takes the place of the seed 0.
ZERO_SEED = 0x9E3779B9


def step(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(F.lit(MASK))
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(F.lit(MASK))


def stream(seed: Column | int, n: Column | int) -> Column:
    """array<bigint>: the first n draws."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    seed = F.when(seed.bitwiseAND(F.lit(MASK)) == 0, F.lit(ZERO_SEED)).otherwise(seed.bitwiseAND(F.lit(MASK)))  # zero would stay zero
    n = F.lit(n) if isinstance(n, int) else n
    empty = F.expr("cast(array() as array<bigint>)")
    fold = F.aggregate(F.sequence(F.lit(1), n), F.struct(seed.alias("x"), empty.alias("out")), lambda acc, _: F.struct(step(acc["x"]).alias("x"), F.concat(acc["out"], F.array(step(acc["x"]))).alias("out")))
    return fold["out"]


def uniform(draw: Column) -> Column:
    return draw / F.lit(4294967296.0)


def below(draw: Column, n: Column | int) -> Column:
    return F.floor(uniform(draw) * n).cast("long")
