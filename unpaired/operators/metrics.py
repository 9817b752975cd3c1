"""Validation and ranking metrics. Predictions have ``y`` (0/1) and ``score``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from unpaired.functions.hashing import hash52
from unpaired.functions.numeric import ratio, rounded, rounded_mean
from unpaired.graph import Graph, same_pair, unordered
from unpaired.operators.ranking import FEW, average_rank, percent_ranks, running_sums, smallest
from unpaired.tables import settle


def _by_score(predictions: DataFrame) -> DataFrame:
    return predictions.where("score is not null").groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))


def leakage(graph: Graph, pairs: DataFrame) -> DataFrame:
    """How many pairs are edges; few pairs are sent to the edges, which then aren't exchanged."""
    pairs = settle(pairs.select("u", "v"), "checked")
    if pairs.count() <= FEW:
        return unordered(graph.edges).join(F.broadcast(unordered(pairs)), ["_lo", "_hi"]).agg(F.count(F.lit(1)).alias("leaked"))
    return graph.positives(pairs).agg(F.count(F.lit(1)).alias("leaked"))


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap between the two distribution functions of ``value``."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(value), F.lit(0), F.lit(1)))
    counts = running_sums(both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "x", ["a", "b"])
    totals = both.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(ratio(F.col("cum_a"), F.col("n_a")) - ratio(F.col("cum_b"), F.col("n_b")))
    return counts.join(F.broadcast(totals)).agg(rounded(F.max(gap)).alias("ks"))


def degree_match(chosen: DataFrame, positives: DataFrame, random: DataFrame, value: str = "degsum") -> DataFrame:
    """KS of chosen against positives and against random pairs, and the three means."""
    mean = lambda df, name: df.agg(rounded(F.avg(value)).alias(name))
    parts = [ks_statistic(chosen, positives, value).withColumnRenamed("ks", "ks_positives"), ks_statistic(random, positives, value).withColumnRenamed("ks", "ks_random_positives"), mean(chosen, "mean_chosen"), mean(positives, "mean_positives"), mean(random, "mean_random")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def hardness_split(records: DataFrame) -> DataFrame:
    return records.groupBy("mode").agg(rounded_mean(F.col("hardness")).alias("mean_hardness"), F.count(F.lit(1)).alias("n"))


def gold_recall(pool: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Gold negatives found in the pool, and how many of them are confident."""
    key = [F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")]
    hit = pool.select(*key, "confidence").join(gold.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), ["lo", "hi"], "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("confidence") >= threshold).alias("confident"), rounded(ratio(F.count_if(F.col("confidence") >= threshold), F.count(F.lit(1)))).alias("recall"), rounded_mean(F.col("confidence")).alias("mean_confidence"))


def auroc(predictions: DataFrame) -> DataFrame:
    """Mann-Whitney, ties counted half; null if a class is missing."""
    counts = running_sums(_by_score(predictions), "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return counts.agg(rounded(ratio(wins, F.sum("pos") * F.sum("neg"))).alias("auroc"))


def average_precision(predictions: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, over distinct scores."""
    own = _by_score(predictions).withColumn("all", F.col("pos") + F.col("neg"))
    counts = running_sums(own, "score", ["pos", "all"], descending=True)
    return counts.agg(rounded(ratio(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_all")), F.sum("pos"))).alias("average_precision"))


def hits_at_k(predictions: DataFrame, k: int, key: str, lowest: bool = False) -> DataFrame:
    """Share of positives among the ``k`` highest (or negatives among the lowest) scores."""
    first = predictions.orderBy(F.asc("score") if lowest else F.desc("score"), key).limit(k)
    hit = 1 - F.col("y") if lowest else F.col("y")
    return first.agg(rounded(F.avg(hit)).alias("hits"), F.count(F.lit(1)).alias("k"))


def mrr(predictions: DataFrame, group: str, key: str) -> DataFrame:
    """Mean over groups of 1 / rank of the first positive; 0 where there is none."""
    order = W.Window.partitionBy(group).orderBy(F.desc("score"), key)
    ranked = predictions.withColumn("_r", F.row_number().over(order))
    first = ranked.groupBy(group).agg(F.min(F.when(F.col("y") == 1, F.col("_r"))).alias("_r"))
    return first.agg(rounded(F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0)))).alias("mrr"))


def youden(predictions: DataFrame) -> DataFrame:
    """The threshold (score >= t is positive) of the largest TPR - FPR, with precision and recall."""
    counts = running_sums(_by_score(predictions), "score", ["pos", "neg"], descending=True)
    totals = _by_score(predictions).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    own = counts.join(F.broadcast(totals)).select("score", ratio(F.col("cum_pos"), F.col("p")).alias("tpr"), ratio(F.col("cum_neg"), F.col("n")).alias("fpr"), ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))
    best = own.agg(F.max(F.struct(rounded(F.col("tpr") - F.col("fpr"), 9).alias("j"), (-F.col("score")).alias("s"), "precision", "tpr")).alias("b"))
    return best.select((-F.col("b.s")).alias("threshold"), rounded(F.col("b.j")).alias("j"), rounded(F.col("b.precision")).alias("precision"), rounded(F.col("b.tpr")).alias("recall"))


def confusion(predictions: DataFrame, threshold: float) -> DataFrame:
    said, true = F.col("score") >= threshold, F.col("y") == 1
    return predictions.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    own = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return own.agg(rounded(F.corr("_ra", "_rb")).alias("spearman"))


def partial_spearman(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    """Rank correlation of ``a`` and ``b`` with the ranks of ``given`` held fixed."""
    own = average_rank(average_rank(average_rank(df.dropna(subset=[a, b, given]), a, "_ra"), b, "_rb"), given, "_rg")
    r = own.agg(F.corr("_ra", "_rb").alias("ab"), F.corr("_ra", "_rg").alias("ag"), F.corr("_rb", "_rg").alias("bg"))
    return r.select(rounded(ratio(F.col("ab") - F.col("ag") * F.col("bg"), F.sqrt((1 - F.col("ag") ** 2) * (1 - F.col("bg") ** 2)))).alias("partial_spearman"))


def quantile_strata(df: DataFrame, by: str, value: str, strata: int = 4) -> DataFrame:
    """(stratum, n, mean): mean of ``value`` in equal parts of the rank of ``by``; ties stay together."""
    known = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    counts = settle(known.groupBy(F.col(by).alias("_v")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("_sum")), "strata")
    own = counts.join(percent_ranks(counts.select("_v", "n"), "_p"), "_v")
    stratum = F.least(F.floor(F.col("_p") * strata), F.lit(strata - 1)).cast("int")
    return own.groupBy(stratum.alias("stratum")).agg(F.sum("n").alias("n"), rounded(F.sum("_sum") / F.sum("n")).alias("mean"))


def hidden_positives(chosen: DataFrame, positives: DataFrame) -> DataFrame:
    """(n, hidden, share): chosen negatives that are positives after all, whichever way round."""
    known = unordered(positives).distinct().withColumn("_hit", F.lit(1))
    own = chosen.select("u", "v").join(known, same_pair(), "left")
    return own.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hidden"), rounded(ratio(F.count("_hit"), F.count(F.lit(1)))).alias("share"))


def non_isolated(graph: Graph, pairs: DataFrame) -> DataFrame:
    """The pairs both of whose ends have a neighbour: the stratum that topology can say something about."""
    busy = graph.degrees.where("k > 0").select("id")
    return pairs.join(busy.withColumnRenamed("id", "u"), "u", "left_semi").join(busy.withColumnRenamed("id", "v"), "v", "left_semi").select(*pairs.columns)


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(rounded(F.corr(a, b)).alias("pearson"))


def lift(df: DataFrame, flag: str, outcome: str) -> DataFrame:
    """Rate of ``outcome`` among flagged rows, overall, and their ratio."""
    flagged, all_ = F.avg(F.when(F.col(flag), F.col(outcome).cast("double"))), F.avg(F.col(outcome).cast("double"))
    return df.agg(rounded(flagged).alias("flagged_rate"), rounded(all_).alias("base_rate"), rounded(ratio(flagged, all_)).alias("lift"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which each column isn't null: (signal, coverage)."""
    one = df.agg(*[rounded(F.avg(F.col(c).isNotNull().cast("double"))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("coverage")) for c in columns])).alias("r")).select("r.*")


def contamination(scored: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """How well a flag cleans a negative set, as one row.

    ``scored`` has ``id``, ``y`` (1: a hidden positive, 0: clean), ``signal`` (null: it
    abstains), ``flag`` and ``other``, a second signal. Given are both AUROCs, the lift of the flag,
    the AUROC on rows that ``other`` takes for safe (its median or less: what one signal adds
    to the other), and a scenario: to all clean rows come hidden ones, ``share`` of their
    number and one at least, drawn by hash, and flagged rows are dropped.
    """
    own = settle(scored.where(F.col("signal").isNotNull() & F.col("other").isNotNull()), "contamination")
    area = lambda rows, score, name: auroc(rows.select("y", F.col(score).alias("score"))).withColumnRenamed("auroc", name)
    safe = own.join(F.broadcast(own.agg(F.median("other").alias("_median")))).where("other <= _median")
    rate = lambda y: F.avg(F.when(F.col("y") == y, F.col("flag").cast("double")))
    counts = own.agg(F.count_if(F.col("y") == 1).alias("n_hidden"), F.count_if(F.col("y") == 0).alias("n_clean"), rounded(ratio(rate(1), rate(0))).alias("lift"), F.count_if((F.col("y") == 0) & F.col("flag")).alias("dropped_clean"))
    total = counts.first()
    added = min(total["n_hidden"], max(1, int(total["n_clean"] * share)))
    drawn = smallest(own.where("y = 1"), added, hash52(seed, F.col("id")), 1 << 52, "id")
    scenario = drawn.agg(F.count(F.lit(1)).alias("added"), F.count_if("flag").alias("dropped_hidden"))
    out = counts
    for part in (scenario, area(own, "signal", "auroc_signal"), area(own, "other", "auroc_other"), area(safe, "signal", "auroc_safe")):
        out = out.join(F.broadcast(part))  # one row each
    left = F.col("n_clean") - F.col("dropped_clean") + F.col("added") - F.col("dropped_hidden")
    return out.select("*", rounded(ratio(F.col("added"), F.col("n_clean") + F.col("added"))).alias("before"), rounded(ratio(F.col("added") - F.col("dropped_hidden"), left)).alias("after"))


def judged_recall(verdicts: DataFrame, positive: str = "suspected_false_negative") -> DataFrame:
    """(recall, false_positive_rate, separation): how often known positives (``y`` 1) and others get the verdict ``positive``."""
    rate = lambda y: F.avg(F.when(F.col("y") == y, (F.col("verdict") == positive).cast("double")))
    return verdicts.agg(rounded(rate(1)).alias("recall"), rounded(rate(0)).alias("false_positive_rate"), rounded(rate(1) - rate(0)).alias("separation"))


def verdict_shares(verdicts: DataFrame) -> DataFrame:
    """(verdict, on_positives, on_others): each verdict's share of the rows with ``y`` 1 and 0."""
    by = verdicts.groupBy("verdict").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("o"))
    return by.join(F.broadcast(by.agg(F.sum("p").alias("_p"), F.sum("o").alias("_o")))).select("verdict", rounded(ratio(F.col("p"), F.col("_p"))).alias("on_positives"), rounded(ratio(F.col("o"), F.col("_o"))).alias("on_others"))
