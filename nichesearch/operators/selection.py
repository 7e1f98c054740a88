"""Selection criteria: novelty (MESS, ExDet), continuous Boyce index, importance weights and weighted AUC, composite scores, regret."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws, ranks
from ..schema import RunResult, SelectionScore

#: Bins of the Boyce index; weights of a candidate's metrics by intended use.
BOYCE_BINS = 10
WEIGHTS: dict[str, dict[str, float]] = {
    "spatial_transfer": {"auc_mean": 1.0, "auc_sd": -0.5, "weighted_auc": 1.0, "novel_share": -0.5},
    "interpolation": {"auc_mean": 1.0, "auc_sd": -1.0, "boyce": 0.5},
    "temporal_projection": {"auc_mean": 1.0, "auc_sd": -0.5, "novel_share": -1.0},
}


def _similarity(value: Column, reference: Column) -> Column:
    """Of a value to a sorted reference: 100 at its median, 0 at its ends, negative beyond them."""
    n = F.size(reference)
    low, high = F.get(reference, F.lit(0)), F.get(reference, n - 1)
    share = 100.0 * F.size(F.filter(reference, lambda x: x < value)) / n
    span = F.when(high > low, high - low).otherwise(1.0)
    inside = F.least(2 * share, 2 * (100 - share))
    return F.when(share == 0, 100 * (value - low) / span).when(value > high, 100 * (high - value) / span).otherwise(inside)


def mess(grid: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Adds mess, the least similarity over the predictors, and novel (below 0); NULL where a predictor is missing.

    ``reference`` (predictors) is a sample of bounded size: its values travel as k sorted arrays.
    """
    own = reference.agg(*[F.sort_array(F.collect_list(F.get("predictors", F.lit(i)))).alias(f"_r{i}") for i in range(k)])
    rows = grid.join(F.broadcast(own))  # one row
    each = [_similarity(F.get("predictors", F.lit(i)), F.col(f"_r{i}")) for i in range(k)]
    whole = F.forall("predictors", lambda x: x.isNotNull())
    rows = rows.withColumn("mess", F.when(whole, F.least(*each) if k > 1 else each[0]))
    return rows.withColumn("novel", F.col("mess") < 0).drop(*[f"_r{i}" for i in range(k)])


def exdet(grid: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Adds exdet: below 0 where a predictor leaves the reference's range, by the summed share of that range; else the squared
    Mahalanobis distance to the reference's mean over its greatest there, above 1 for combinations that it lacks.

    NULL where a predictor is missing. The reference comes as one row of ranges, means and products; its k by k covariance is inverted at the driver.
    """
    layer = lambda i: F.get("predictors", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = reference.agg(*[f(layer(i)).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg)) for i in range(k)], *[F.covar_pop(layer(i), layer(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if stats["low0"] is None:
        return grid.withColumn("exdet", F.lit(None).cast("double"))
    covariance = np.zeros((k, k))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = stats[f"c{i}_{j}"]
    inverse = np.linalg.pinv(covariance)
    apart = [layer(i) - F.lit(stats[f"mean{i}"]) for i in range(k)]
    squared = sum([F.lit(float(inverse[i, j])) * apart[i] * apart[j] for i in range(k) for j in range(k)], F.lit(0.0))
    most = reference.agg(F.max(squared)).first()[0]

    def outside(i: int) -> Column:
        low, high = stats[f"low{i}"], stats[f"high{i}"]
        return F.least(F.lit(0.0), layer(i) - F.lit(low), F.lit(high) - layer(i)) / F.lit((high - low) or 1.0)

    beyond = sum([outside(i) for i in range(k)], F.lit(0.0))
    whole = F.forall("predictors", lambda x: x.isNotNull())
    return grid.withColumn("exdet", F.when(whole, F.when(beyond < 0, beyond).otherwise(squared / F.lit(most or 1.0))))


def importance_weights(rows: DataFrame, landscape: DataFrame, k: int, bins: int = 3) -> DataFrame:
    """Adds weight: how much commoner a record's environment is in the landscape than among ``rows`` (predictors).

    An environment is a cell of ``bins`` quantile bins of each predictor of the landscape. Scores under these weights estimate
    what they would be over the landscape. NULL where a predictor is missing.
    """
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = landscape.agg(*[F.percentile(F.get("predictors", F.lit(i)), at).alias(f"_e{i}") for i in range(k)])

    def passed(i: int) -> Column:
        return F.size(F.filter(f"_e{i}", lambda e: e <= F.get("predictors", F.lit(i))))

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(edges))  # one row
        own = F.concat_ws(":", *map(passed, range(k)))
        return df.withColumn("_cell", F.when(F.forall("predictors", lambda x: x.isNotNull()), own)).drop(*[f"_e{i}" for i in range(k)])

    every = Window.partitionBy()  # a row a cell
    share = lambda df, name: placed(df).filter("_cell IS NOT NULL").groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", (F.col("_n") / F.sum("_n").over(every)).alias(name))
    ratio = share(rows, "_own").join(share(landscape, "_all"), "_cell", "left").select("_cell", F.coalesce(F.col("_all") / F.col("_own"), F.lit(0.0)).alias("weight"))
    return placed(rows).join(F.broadcast(ratio), "_cell", "left").drop("_cell")


def density_ratio(rows: DataFrame, landscape: DataFrame, k: int, centres: int = 100, width: float = 1.0, ridge: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds weight: the density of a record's environment in the landscape over that among ``rows`` (predictors), by least squares (uLSIF).

    The ratio is a sum of Gaussians, ``width`` deviations wide, at ``centres`` complete cells of the landscape (by
    hash). Its weights solve (H + ridge I) a = h, where H is the mean of the products of kernels over ``rows`` and h
    that of the kernels over the landscape: two sums over the data, and a system of ``centres`` equations for the driver. Where the sum
    is negative the weight is 0; NULL where a predictor is missing.
    """
    from .learners import total_of

    whole = F.forall("predictors", lambda x: x.isNotNull())
    place = landscape.filter(whole).select("predictors").orderBy(F.xxhash64(F.lit(seed), "predictors"), "predictors").limit(centres)
    at = np.array([r[0] for r in place.collect()], float).reshape(-1, k)
    spread = landscape.filter(whole).agg(*[F.stddev_pop(F.get("predictors", F.lit(i))) for i in range(k)]).first()
    scale = np.array([s if s else 1.0 for s in spread], float)

    def kernels(x: np.ndarray) -> np.ndarray:
        return np.exp(-(((x[:, None, :] - at[None]) / scale) ** 2).sum(axis=2) / (2 * width**2))

    def products(x: np.ndarray) -> np.ndarray:
        phi = kernels(x)
        return np.r_[len(x), (phi.T @ phi).ravel()]

    own = total_of(rows.filter(whole), "predictors", k, products)
    all_ = total_of(landscape.filter(whole), "predictors", k, lambda x: np.r_[len(x), kernels(x).sum(axis=0)])
    c = len(at)
    if not c or own is None:
        return rows.withColumn("weight", F.lit(None).cast("double"))
    a = np.linalg.solve(own[1:].reshape(c, c) / own[0] + ridge * np.eye(c), all_[1:] / all_[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index("predictors")).to_pylist():
                out.append(None if x is None or None in x else max(0.0, float(kernels(np.array([x]))[0] @ a)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "weight"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("weight", T.DoubleType())]))


def boyce_bins(scored: DataFrame, bins: int = BOYCE_BINS) -> DataFrame:
    """(bin, presences, available, ratio) from rows (label, score in [0, 1]): shares of presences over shares of all, by equal bins."""
    which = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(which.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("presences"), F.count("*").alias("available"))
    every = Window.partitionBy()  # a row a bin
    share = (F.col("presences") / F.sum("presences").over(every)) / (F.col("available") / F.sum("available").over(every))
    return counts.withColumn("ratio", share)


def boyce(scored: DataFrame, bins: int = BOYCE_BINS) -> DataFrame:
    """(boyce): Spearman's correlation of the bins' places and ratios, ties at their average rank."""
    rows = boyce_bins(scored, bins)
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0)
    ranked = rows.select(average("bin").alias("a"), average("ratio").alias("b"))
    return ranked.agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("boyce"))


def weighted_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., weighted_auc) from rows (label, score, weight): the share of weighted pairs in the right order, ties half.

    Weights are summed by score first; running sums over ranges of the distinct scores do the rest.
    """
    w = lambda k: F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0.0))
    values = scored.groupBy(*by, "score").agg(w(1).alias("p"), w(0).alias("q"))
    rows = ranks.running(values, by, "score", ["q"])
    rows = rows.select(*by, "p", "q", (F.col("p") * (F.col("q_before") + F.col("q") / 2)).alias("right"))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("right"), F.sum("p") * F.sum("q")).alias("weighted_auc"))


#: P(Poisson(1) <= k) for k from 0 on: how often a record is drawn in a bootstrap replicate.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10))


def bootstrap_auc(scored: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(by..., replicate, auc) of rows (record_id, label, score): each replicate weighs a record by a Poisson number of its hash.

    Candidates that share records share their weights, so that their AUCs in a replicate can be compared. All replicates are one aggregation.
    """
    rows = scored.select(*by, "record_id", "label", "score", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    # as a row of its own a draw's hash is worked out once, else for every comparison
    key = draws.order_key(seed, "bootstrap", F.col("replicate"), F.col("record_id"))
    rows = rows.select(*by, "replicate", "label", "score", F.inline(F.array(F.struct(key.alias("_key"))))).filter(draws.above(F.col("_key"), POISSON[0]))
    weight = sum((draws.above(F.col("_key"), p).cast("int") for p in POISSON[1:]), F.lit(1))
    rows = rows.withColumn("weight", weight.cast("double")).drop("_key")
    return weighted_auc(rows, [*by, "replicate"]).withColumnRenamed("weighted_auc", "auc")


def stability(scored: DataFrame, replicates: int = 50, seed: int = 42) -> DataFrame:
    """(candidate_id, auc, sd, wins) of rows (candidate_id, fold, record_id, label, score): mean and deviation over replicates of the mean over folds, and the share of replicates in which the candidate is best, ties shared."""
    each = bootstrap_auc(scored, ["candidate_id", "fold"], replicates, seed).groupBy("candidate_id", "replicate").agg(F.avg("auc").alias("auc"))
    own = Window.partitionBy("replicate")  # a row a candidate
    best = (F.col("auc") == F.max("auc").over(own)).cast("int")
    each = each.withColumn("best", best).withColumn("win", F.col("best") / F.sum("best").over(own))
    return each.groupBy("candidate_id").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd"), (F.sum("win") / replicates).alias("wins"))


def concordance(aucs: DataFrame) -> DataFrame:
    """(n_candidates, n_folds, w): Kendall's W of the candidates' ranks over folds, from rows (candidate_id, fold, auc); 1 where all folds agree. Folds that lack a candidate's AUC are left out."""
    known = aucs.filter("auc is not null").withColumns({"n": F.count("*").over(Window.partitionBy("fold"))})  # a row a candidate and fold from here on
    n = known.agg(F.count_distinct("candidate_id").alias("n_candidates"))
    known = known.join(F.broadcast(n)).filter("n = n_candidates")
    rank = F.rank().over(Window.partitionBy("fold").orderBy("auc")) + (F.count("*").over(Window.partitionBy("fold", "auc")) - 1) / F.lit(2.0)
    sums = known.withColumn("rank", rank).groupBy("candidate_id", "n_candidates").agg(F.sum("rank").alias("r"), F.count("*").alias("n_folds"))
    k, m = F.first("n_candidates"), F.first("n_folds")
    return sums.agg(k.alias("n_candidates"), m.alias("n_folds"), F.try_divide(12 * F.var_pop("r") * k, m * m * (k * k * k - k)).alias("w"))


def composite(metrics: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(candidate_id, total) from rows (candidate_id, metric, value); metrics without a weight don't count."""
    known = metrics.filter(F.col("metric").isin(list(weights)))
    weight = None
    for name, w in weights.items():
        weight = F.when(F.col("metric") == name, F.lit(float(w))) if weight is None else weight.when(F.col("metric") == name, F.lit(float(w)))
    return known.groupBy("candidate_id").agg(F.sum(weight * F.col("value")).alias("total"))


def select(result: RunResult, weights: Mapping[str, float] | None = None) -> RunResult:
    """The run with a score for each candidate that finished, and the best one's id; ties go to the id that sorts first."""
    weights = weights or WEIGHTS[result.manifest.objective]
    scored = []
    for c in result.candidates:
        if not c.failed:
            parts = {k: w * c.metrics[k] for k, w in weights.items() if k in c.metrics}
            missing = tuple(f"no {k}" for k in weights if k not in c.metrics)
            c = c.replace(score=SelectionScore(c.plan.candidate_id, sum(parts.values()), parts, missing))
        scored.append(c)
    done = sorted((-c.score.total, c.plan.candidate_id) for c in scored if c.score)
    return result.replace(candidates=tuple(scored), selected=done[0][1] if done else None)


def regret(truth: DataFrame) -> DataFrame:
    """(species, regret) from rows (species, candidate_id, total, score_true): the true score of the pick less the best's; at most 0."""
    pick = F.max_by("score_true", F.struct("total", "candidate_id"))
    return truth.groupBy("species").agg((pick - F.max("score_true")).alias("regret"))
