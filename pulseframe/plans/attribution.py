"""The kind of a claim from its axes: boosted trees, a prediction set with a coverage of its own for each kind, and abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import linear, quantiles, stats
from pulseframe.plans import boosting
from pulseframe.session import cut

#: For tables of claims, which are small.
SMALL = boosting.Settings(rounds=4, rate=0.5, levels=2, least=2, penalty=1.0, codes=8)


def margins(p: Column, k: int) -> Column:
    """array<double>: how far the best other class lies above each of k."""
    return F.array(*[F.greatest(*[F.get(p, F.lit(i)) for i in range(k) if i != j], F.lit(0.0)) - F.get(p, F.lit(j)) for j in range(k)])


def attribute(rows: DataFrame, axes: list[str], kind: str, fitted: Column, known: Column, alpha: dict[str, float], default: float = 0.10, far: float = 0.99, settings: boosting.Settings = SMALL) -> DataFrame:
    """Rows that aren't known, with said, the likeliest kind, its probability, and kinds, the set that holds the right one with
    probability 1 - alpha; null, an abstention, where the set is empty or the axes lie farther out than a share `far` of the fitted rows.

    fitted marks the rows that trees are fitted on; the other known ones calibrate the sets. A kind with fewer than five of
    these is always in the set.
    """
    fit = rows.where(fitted)
    keep = linear.usable(fit, axes)
    bundle, _ = boosting.fit(fit, keep, kind, settings)
    classes = bundle["classes"]
    _, means, cov = linear.moments(fit, keep)
    filled = lambda d: d.withColumns({f"_f{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(m))) for i, (c, m) in enumerate(zip(keep, means, strict=True))})
    out = linear.mahalanobis([f"_f{i}" for i in range(len(keep))], means, linear.shrunk_inverse(cov, 0.1))
    limit = quantiles.one(filled(fit), out, far)
    scored = cut(filled(rows.where(~fitted)).withColumns({"_raw": boosting.scores(bundle, F.array(*[F.col(c).cast("double") for c in keep])), "_far": out > limit}))
    scored = cut(scored.withColumn("_p", boosting.softmax(F.col("_raw"))).drop("_raw"))
    scored = scored.withColumn("_m", margins(F.col("_p"), len(classes)))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(kind)).cast("int") - 1
    own = scored.where(known).withColumn("_own", F.get("_m", place)).select(kind, "_own")
    limits: dict = {}
    for a in {default, *alpha.values()}:
        of = [c for c in classes if alpha.get(c, default) == a]
        some = own.where(F.col(kind).isin(of))
        many = some.groupBy(kind).agg(F.count("*").alias("n")).where("n >= 5")
        limits |= {r[kind]: r["q"] for r in stats.conformal_quantile("_own", [kind], a, some).join(many, kind).collect()}  # a row for each kind
    within = F.filter(F.array(*[F.when(F.get("_m", F.lit(j)) <= F.lit(float(limits.get(c, 1.0))), F.lit(c)) for j, c in enumerate(classes)]), lambda c: c.isNotNull())
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    done = scored.where(~known).withColumn("_set", within)
    said = F.get(F.array(*[F.lit(c) for c in classes]), best)
    return done.select(*rows.columns, said.alias("said"), F.when((F.size("_set") > 0) & ~F.col("_far"), F.col("_set")).alias("kinds"), F.array_max("_p").alias("probability"))
