"""Measures that choose the parameters: rank AUC, thresholds, recall curves, sketch error, skew, grids and projections.

Every measure is an aggregate over scores or bucket sizes. Running totals are taken over distinct scores or sizes, whose
number is bounded by their precision and not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlake.operators import draws

# The weight of a false merge against a missed one, and the recall that may be lost in retrieval.
COST_RATIO, LOSS_BUDGET = 50.0, 0.01


def _tallies(scores: DataFrame) -> DataFrame:
    """(score, p, n): positives and negatives at each distinct score of (score, positive)."""
    return scores.groupBy("score").agg(F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("n"))


def _before(order: Column) -> Window:
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def auc(scores: DataFrame) -> DataFrame:
    """The chance that a positive scores above a negative, ties half: average ranks by running counts over distinct scores."""
    tallied = _tallies(scores).withColumn("below", F.coalesce(F.sum(F.col("p") + F.col("n")).over(_before(F.col("score").asc())), F.lit(0)))
    rank = F.col("below") + (F.col("p") + F.col("n") + 1) / 2
    found = tallied.agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return found.select(((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"), F.col("np").alias("positives"), F.col("nn").alias("negatives"))


def recall_at_zero_false(scores: DataFrame) -> DataFrame:
    """The share of positives that score above every negative, and the highest negative."""
    tallied = _tallies(scores)
    top = F.lit(tallied.where("n > 0").agg(F.max("score")).first()[0])
    return tallied.agg(top.alias("highest_negative"), (F.sum(F.when(F.col("score") > top, F.col("p")).otherwise(0)) / F.sum("p")).alias("recall"))


def threshold_costs(scores: DataFrame, ratio: float = COST_RATIO, ends: bool = False) -> DataFrame:
    """(threshold, false_positive_rate, false_negative_rate, cost) at each distinct score; with `ends` also at 0 and 1."""
    tallied = _tallies(scores)
    if ends:
        zero = F.lit(0).cast("bigint")
        more = tallied.sparkSession.createDataFrame([(0.0,), (1.0,)], "score double").select("score", zero.alias("p"), zero.alias("n"))
        tallied = tallied.unionByName(more).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    positives, negatives = tallied.agg(F.sum("p"), F.sum("n")).first()
    run = tallied.select("score", F.coalesce(F.sum("p").over(_before(F.col("score").asc())), F.lit(0)).alias("missed"), (F.col("n") + F.coalesce(F.sum("n").over(_before(F.col("score").desc())), F.lit(0))).alias("wrong"))
    found = run.select(F.col("score").alias("threshold"), (F.col("wrong") / F.lit(negatives)).alias("false_positive_rate"), (F.col("missed") / F.lit(positives)).alias("false_negative_rate"))
    return found.withColumn("cost", F.lit(ratio) * F.col("false_positive_rate") + F.col("false_negative_rate"))


def best_threshold(scores: DataFrame, ratio: float = COST_RATIO, ends: bool = False) -> DataFrame:
    """The lowest threshold of the least cost."""
    return threshold_costs(scores, ratio, ends).orderBy(F.round("cost", 12), "threshold").limit(1)


def score_quantiles(scores: DataFrame, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles with linear interpolation, of positives and negatives."""
    return scores.groupBy("positive").agg(F.count(F.lit(1)).alias("n"), *[F.percentile("score", q).alias(f"q{round(100 * q):02d}") for q in shares])


def curve(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, pairs, candidates, share) of pairs (jaccard, candidate) by similarity."""
    at = F.least(F.floor(F.col("jaccard") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("candidate").cast("int")).alias("candidates")).withColumn("share", F.col("candidates") / F.col("pairs"))


def recall(pairs: DataFrame, tau: float) -> DataFrame:
    """How many of the pairs at or above tau are candidates."""
    return pairs.where(F.col("jaccard") >= tau).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.col("candidate").cast("int")), F.lit(0)).alias("found"))


def sketch_error(estimates: DataFrame, k: int) -> DataFrame:
    """Bias, spread and worst error of (j_sketch, j_exact), beside what theory says for k rows; one row."""
    e = F.col("j_sketch") - F.col("j_exact")
    theory = F.sqrt(F.avg(F.col("j_exact") * (1 - F.col("j_exact")) / k))
    return estimates.agg(F.count(F.lit(1)).alias("pairs"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), theory.alias("theory"), F.max(F.abs(e)).alias("worst"), F.avg((F.abs(e) <= 1.96 * F.sqrt(F.col("j_exact") * (1 - F.col("j_exact")) / k)).cast("int")).alias("inside_95")).select(F.lit(k).alias("k"), "*")


def error_by_bin(estimates: DataFrame, bins: int = 10) -> DataFrame:
    e = F.col("j_sketch") - F.col("j_exact")
    return estimates.groupBy(F.least(F.floor(F.col("j_exact") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(e).alias("spread"))


def seeded_sample(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows without replacement, (place, id): the smallest hashes of id and seed, so the same rows on any number of partitions."""
    keyed = rows.select(F.col(id_col).alias("id"), F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))).alias("draw"))
    drawn = keyed.orderBy("draw", "id").limit(n)
    return drawn.select((F.row_number().over(Window.orderBy("draw", "id")) - 1).alias("place"), "id")


def random_pairs(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n pairs (a, b), a < b, of different sampled ids: neighbours in the order of the draw."""
    pair = seeded_sample(rows, 2 * n, seed, id_col).groupBy(F.floor(F.col("place") / 2).alias("pair"))
    return pair.agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b")


def _poisson_steps(bits: int = 32) -> list[int]:
    """How often a row occurs in a resample follows Poisson with mean 1: the counts' limits in a uniform number of so many bits."""
    steps, share, term = [], 0.0, math.exp(-1)
    for k in range(1, 14):
        share += term
        term /= k
        steps.append(int(share * 2**bits))
    return steps


def bootstrap_recall(scores: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(resamples, low, high): the central 95 % of recall_at_zero_false over resamples of (key, score, positive).

    A hash of key, resample and seed tells how often a row is drawn, so the same rows are drawn on any number of partitions.
    Rows are counted by resample and score where they are drawn. A resample without a negative has a recall of 1, one without
    a positive has none.
    """
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.select("key", F.col("score").cast("double").alias("score"), "positive").repartition(tasks)  # each row is hashed `resamples` times
    drawn = rows.mapInArrow(draws.tally(resamples, seed, _poisson_steps()), "resample int, score double, p long, n long")
    tallied = drawn.groupBy("resample", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    top = F.max(F.when(F.col("n") > 0, F.col("score"))).over(Window.partitionBy("resample"))
    above = F.sum(F.when(F.col("top").isNull() | (F.col("score") > F.col("top")), F.col("p")).otherwise(0))
    found = tallied.withColumn("top", top).groupBy("resample").agg(F.try_divide(above, F.sum("p")).alias("recall"))
    return found.agg(F.count("recall").alias("resamples"), F.percentile("recall", 0.025).alias("low"), F.percentile("recall", 0.975).alias("high"))


def representation(scores: DataFrame, ratio: float = COST_RATIO, z: float = 3.0902) -> DataFrame:
    """How well a representation's (score, positive) separate, and the sketch rows its threshold would need; one row.

    The resolution is how far the threshold lies above the bulk (99 %) of the negatives, 0.001 at least. Scores should have a
    few decimals only, as running counts go over the distinct ones.
    """
    best, ranks, top = (x.first() for x in (best_threshold(scores, ratio), auc(scores), recall_at_zero_false(scores)))  # a row each
    tau = best["threshold"] if best else None
    negative = F.when(~F.col("positive"), F.col("score"))
    positive = F.when(F.col("positive"), F.col("score"))
    row = scores.agg(F.max(negative).alias("diff_max"), F.percentile(negative, 0.99).alias("diff_p99"), F.percentile(positive, 0.5).alias("same_median"), F.avg((positive >= F.lit(tau)).cast("int")).alias("merged_share"))
    gap = F.greatest(F.lit(tau) - F.col("diff_p99"), F.lit(0.001))
    row = row.select(F.lit(tau).cast("double").alias("tau"), "*", gap.alias("resolution"))
    needed = F.ceil(F.round(F.lit(rows_needed(tau, 1.0, z) if best else None).cast("double") / (F.col("resolution") * F.col("resolution")), 6))
    return row.select(F.lit(ranks["auc"]).cast("double").alias("auc"), F.lit(top["recall"]).cast("double").alias("recall"), "*", needed.cast("bigint").alias("rows_required"))


def paired_shift(pairs: DataFrame, least: float = 0.02) -> DataFrame:
    """What a change of representation does to the same pairs (a, b, before, after, label), by label.

    (label, pairs, mean_shift, lifted, hurt, top_a, top_b): shifts beyond `least` count; the pair lifted most is named, of equal
    ones that of the smallest ids.
    """
    shift = F.col("after") - F.col("before")
    place = F.struct(F.round(shift, 9), -F.col("a"), -F.col("b"))
    by = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg(shift).alias("mean_shift"), F.count(F.when(shift > least, 1)).alias("lifted"), F.count(F.when(shift < -least, 1)).alias("hurt"), F.max_by(F.struct("a", "b"), place).alias("top"))
    return by.select("label", "pairs", "mean_shift", "lifted", "hurt", F.col("top.a").alias("top_a"), F.col("top.b").alias("top_b"))


def row_dependence(estimates: DataFrame, k: int, blocks: int) -> DataFrame:
    """Whether a sketch's rows are independent, from (same, j_exact) with a bit for each equal one of k rows; one row.

    half_correlation is that of the errors of both halves, half_spread the deviation of their difference beside the expected
    one, block_variance the mean variance among blocks of rows beside that of a binomial.
    """
    share = lambda start, n: F.bit_count(F.col("same").bitwiseAND((2**n - 1) << start)) / F.lit(float(n))
    half, width, j = k // 2, k // blocks, F.col("j_exact")
    found = estimates.select("j_exact", (share(0, half) - j).alias("e"), (share(half, half) - j).alias("f"), F.array(*[share(i * width, width) for i in range(blocks)]).alias("shares"))
    total = lambda f: F.aggregate(F.transform("shares", f), F.lit(0.0), lambda n, x: n + x)
    spread = (total(lambda x: x * x) - F.pow(total(lambda x: x), F.lit(2.0)) / blocks) / (blocks - 1)
    law = lambda n: F.avg(j * (1 - j) / n)
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.corr("e", "f").alias("half_correlation"), F.var_samp("e").alias("half_variance"), F.stddev_pop(F.col("e") - F.col("f")).alias("half_spread"), F.sqrt(2 * law(half)).alias("expected_spread"), F.avg(spread).alias("block_variance"), law(width).alias("binomial_variance"))


def monte_carlo(pairs: DataFrame, rows: int = 96, replications: int = 400, seed: int = 2) -> DataFrame:
    """The spread of estimates under truly independent permutations beside the law's, for each of a few stated pairs (a, b, set_a, set_b).

    (a, b, jaccard, drawn_spread, law_spread). Permutations are drawn one replication at a time, rows x union numbers in memory.
    """

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a, b, left, right in zip(frame.a, frame.b, frame.set_a, frame.set_b, strict=True):
                union = np.union1d(left, right)
                in_left, in_right = np.isin(union, left), np.isin(union, right)
                jaccard = float((in_left & in_right).mean()) if len(union) else 0.0
                rng = np.random.default_rng([seed, int(a), int(b)])
                met = [float(np.mean((in_left & in_right)[rng.random((rows, len(union))).argmin(axis=1)])) for _ in range(replications)] if len(union) else [0.0]
                out.append((a, b, jaccard, float(np.std(met)), math.sqrt(jaccard * (1 - jaccard) / rows)))
            yield pd.DataFrame(out, columns=["a", "b", "jaccard", "drawn_spread", "law_spread"])

    return pairs.select("a", "b", "set_a", "set_b").mapInPandas(draw, "a long, b long, jaccard double, drawn_spread double, law_spread double")


def log_slope(points: DataFrame, x: str, y: str) -> DataFrame:
    """The power with which y follows x: least squares over the logarithms."""
    return points.agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"), F.corr(F.ln(x), F.ln(y)).alias("correlation"))


def zero_event_bound(trials: Column) -> Column:
    """The 95 % upper bound of a rate of which no event was seen."""
    return 1 - F.pow(F.lit(0.05), 1 / trials)


def rows_needed(tau: float, delta: float, z: float = 1.96) -> float:
    """Rows of a sketch so that an estimate at tau is within delta."""
    return z * z * tau * (1 - tau) / (delta * delta)


def size_histogram(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("buckets"))


def emissions(sizes: DataFrame, cap: int | None = None) -> DataFrame:
    """(emissions, colliding_buckets, largest_bucket, suppressed_buckets, suppressed_members): what expanding the buckets costs."""
    m = F.col("members")
    small = F.lit(True) if cap is None else m <= cap
    kept = small & (m > 1)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("bigint")
    return sizes.agg(total(kept, m * (m - 1) / 2).alias("emissions"), F.count(F.when(kept, 1)).alias("colliding_buckets"), F.max(m).alias("largest_bucket"), F.count(F.when(~small, 1)).alias("suppressed_buckets"), total(~small, m).alias("suppressed_members"))


def concentration(sizes: DataFrame, shares: tuple[float, ...] = (0.001, 0.005, 0.01, 0.05, 0.10)) -> DataFrame:
    """(share, buckets, share_of_emissions): what the largest buckets cost. From the histogram of sizes, so no bucket is sorted."""
    m, b = F.col("members").cast("double"), F.col("buckets").cast("double")
    work = m * (m - 1) / 2
    hist = size_histogram(sizes.where("members > 1"))
    up = _before(F.col("members").desc())
    run = hist.select("members", b.alias("b"), work.alias("work"), F.coalesce(F.sum(b).over(up), F.lit(0.0)).alias("above"), F.coalesce(F.sum(b * work).over(up), F.lit(0.0)).alias("done"))
    n, total = run.agg(F.sum("b"), F.sum(F.col("b") * F.col("work"))).first()
    wanted = F.array(*[F.struct(F.lit(q).alias("share"), F.lit(float(max(int((n or 0) * q), 1))).alias("buckets")) for q in shares])
    found = run.select("*", F.inline(wanted)).where((F.col("above") < F.col("buckets")) & (F.col("above") + F.col("b") >= F.col("buckets")))
    return found.select("share", F.col("buckets").cast("bigint").alias("buckets"), ((F.col("done") + (F.col("buckets") - F.col("above")) * F.col("work")) / F.lit(total)).alias("share_of_emissions"))


def attribution(work: DataFrame, group: str) -> DataFrame:
    """(group, notices, mean_work, total_work, share_of_work, share_of_corpus) of (group, emissions)."""
    by = work.groupBy(group).agg(F.count(F.lit(1)).alias("notices"), F.avg("emissions").alias("mean_work"), F.sum("emissions").alias("total_work"))
    notices, total = by.agg(F.sum("notices"), F.sum("total_work")).first()
    return by.select(group, "notices", "mean_work", "total_work", (F.col("total_work") / F.lit(total)).alias("share_of_work"), (F.col("notices") / F.lit(notices)).alias("share_of_corpus"))


def worst_bucket(sizes: DataFrame) -> DataFrame:
    return sizes.orderBy(F.desc("members"), "band_no", "bucket_key").limit(1)


def operating_point(grid: DataFrame, least_recall: float = 1 - LOSS_BUDGET) -> DataFrame:
    """Of (bands, rows, emissions, recall) the cheapest that recalls enough, else the one that recalls most."""
    enough = F.col("recall") >= least_recall
    return grid.orderBy(F.desc(enough), F.when(enough, F.col("emissions").cast("double")).otherwise(-F.col("recall")), "bands").limit(1)


def projection(spark: SparkSession, notices: int, emitted: int, seconds_a_pair: float, at: list[int]) -> DataFrame:
    """Scoring seconds at larger corpora: uncapped work grows with the square, all pairs are n (n - 1) / 2."""
    rows = spark.createDataFrame([(n,) for n in at], "notices bigint")
    n = F.col("notices").cast("double")
    return rows.select("notices", (F.lit(emitted * seconds_a_pair) * F.pow(n / notices, F.lit(2.0))).alias("bucket_seconds"), (n * (n - 1) / 2 * seconds_a_pair).alias("all_pairs_seconds"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
