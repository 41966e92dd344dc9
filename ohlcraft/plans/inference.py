"""Standard errors of dependent streams, and intervals by resampling that move no resampled row."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import Frame
from ..operators.running import running
from ..sources.store import settled
from .portfolio import BOOK, hashed, lag_correlations, lag_sums

c = F.col


def nw_z(stream: DataFrame, lags: int = 500, book: str = BOOK, min_obs: int = 30) -> DataFrame:
    """z of the mean with ``n / max(1, 1 + 2 * sum of lag correlations)`` independent bars; null under ``min_obs`` bars."""
    base = stream.groupBy(book).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    rho = lag_correlations(stream, lags, book).join(base.select(book, c("n").alias("_n")), book)
    rho = rho.filter(c("k") <= c("_n") - 10).groupBy(book).agg(F.sum("rho").alias("srho"))
    free = c("n") / F.greatest(F.lit(1.0), 1 + 2 * F.coalesce("srho", F.lit(0.0)))
    return base.join(rho, book, "left").select(book, "n", F.when((c("n") >= min_obs) & (c("sd") > 0), c("mean") / (c("sd") / F.sqrt(free))).alias("z"))


def nw_covariance_sharpe(stream: DataFrame, lags: int = 500, per_year: float = 6 * 365, book: str = BOOK, stop: float = 0.01, first: int = 8) -> DataFrame:
    """Annual Sharpe ratio over the long-run variance: the variance plus twice the autocovariances before the first small one.

    A covariance is small under ``stop`` times the variance. All books exchange the borders of their chunks once per band of
    lags; bands widen fourfold until every book has met a small covariance or has no lag left, so that the many lags behind
    it are never added up. Result: book, n, ``used`` (lags added), ``sharpe_nw``.
    """
    base = settled(stream.groupBy(book).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.var_pop("r").alias("v0")))
    lo, hi, seen = 1, first, None
    while True:
        sums = lag_sums(stream, min(hi, lags - 1), lo, book).join(base.select(book, c("n").alias("_n"), "mean", "v0"), book)
        cov = (c("sxy") - c("mean") * (c("sx") + c("sy")) + c("n") * c("mean") * c("mean")) / c("_n")
        band = settled(sums.filter(c("k") < F.least(F.lit(lags), c("_n") - 1)).select(book, "k", cov.alias("cov"), (F.abs(cov) < stop * c("v0")).alias("small"), "_n"))
        seen = band if seen is None else seen.unionByName(band)
        open_ = seen.groupBy(book, "_n").agg(F.max("small").alias("_s")).filter(~c("_s") & (c("_n") - 2 > hi))
        if hi >= lags - 1 or open_.isEmpty():
            break
        lo, hi = hi + 1, 4 * hi
    ends = seen.filter("small").groupBy(book).agg(F.min("k").alias("_end"))
    used = seen.join(ends, book, "left").filter(c("_end").isNull() | (c("k") < c("_end"))).groupBy(book).agg(F.sum("cov").alias("_c"), F.count(F.lit(1)).alias("used"))
    long_run = F.greatest(c("v0") + 2 * F.coalesce("_c", F.lit(0.0)), F.lit(1e-18))
    return base.join(used, book, "left").select(book, "n", F.coalesce("used", F.lit(0)).alias("used"), (c("mean") * per_year / F.sqrt(long_run * per_year)).alias("sharpe_nw"))


def annual_interval(stream: DataFrame, block: int = 30, reps: int = 10_000, seed: int = 7, per_year: float = 365, book: str = BOOK) -> DataFrame:
    """Annual mean in percent and its 95 % interval from blocks that start anywhere and don't wrap around.

    Block sums are differences of prefix sums, so that a replicate costs two lookups per block. Books shorter than a block are left out.
    """
    f = running(Frame.of_numbered(stream.select(book, "idx", "r"), 0, key=book), _s=("sum", c("r")))
    prefix = settled(f.core(book, (c("idx") + 1).alias("at"), c("_s").alias("s")))
    size = prefix.groupBy(book).agg(F.max("at").alias("n"), F.max_by("s", "at").alias("total")).filter(c("n") >= block)
    plan = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(book, "rep")
    plan = plan.withColumn("j", F.explode(F.sequence(F.lit(0), (F.ceil(c("n") / block) - 1).cast("int"))))
    plan = plan.withColumn("a", (hashed(F.lit(seed), c("rep"), c("j")) % (c("n") - block + 1)).cast("long")).withColumn("b", c("a") + F.least(F.lit(block), c("n") - c("j") * block))
    ends = [prefix.select(book, c("at").alias(x), c("s").alias(f"s{x}")) for x in ("a", "b")]
    sums = plan.join(ends[0], [book, "a"], "left").join(ends[1], [book, "b"])
    means = sums.groupBy(book, "rep", "n", "total").agg((F.sum(c("sb") - F.coalesce("sa", F.lit(0.0))) / F.max("n")).alias("m"))
    year = 100.0 * per_year
    return means.groupBy(book, "n").agg((F.max("total") / F.max("n") * year).alias("annual"), (F.percentile("m", 0.025) * year).alias("lo"), (F.percentile("m", 0.975) * year).alias("hi"))


#: Hashes from which on a row counts once, twice, ... in a replicate: the distribution function of a Poisson variable of mean 1.
POISSON = [int(sum(exp(-1) / factorial(i) for i in range(k + 1)) * 2_147_483_647) for k in range(12)]


def poisson_bootstrap(pairs: DataFrame, reps: int = 2000, seed: int = 7, book: str = BOOK) -> DataFrame:
    """Mean of ``a - b`` with a resampled interval: each row counts a hashed Poisson number of times in each replicate.

    Counts need no other row, so replicates are added up in the task that holds the rows; what moves is one sum per task, book and replicate.
    """
    d = pairs.filter(c("a").isNotNull() & c("b").isNotNull()).select(book, "idx", (c("a") - c("b")).alias("d"))
    u = hashed(F.lit(seed), c("rep"), c("idx"))
    times = sum(((u >= t).cast("int") for t in POISSON), F.lit(0))
    drawn = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("k", times)
    means = drawn.groupBy(book, "rep").agg((F.sum(c("k") * c("d")) / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    out = means.groupBy(book).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((c("m") <= 0).cast("double")).alias("p_le0"))
    return d.groupBy(book).agg(F.count("d").alias("n"), F.avg("d").alias("diff")).join(out, book)
