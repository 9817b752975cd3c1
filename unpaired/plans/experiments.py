"""Frozen-pool experiments: arms, ablations, splits, injection and learned baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unpaired.functions.hashing import fold, hash52, parity
from unpaired.functions.numeric import ratio, rounded
from unpaired.graph import Graph, excluding
from unpaired.operators import candidates, complement, fusion, manifold, metrics, ranking, selection, topology
from unpaired.tables import settle

FEATURES = ("deg_u", "deg_v", "cn", "jaccard", "aa", "ra", "pref")
#: Tasks at most that count the values of the complement; each exchanges no more than the 10,001 values of four digits.
COUNTING = 1024


def frozen_pool(graph: Graph, max_pool: int | None, seed: int = 0, pairs: DataFrame | None = None) -> DataFrame:
    """Candidates (or given pairs) with structured, topology, confidence, hardness, degsum."""
    pairs = candidates.generate_candidates(graph, max_pool, seed) if pairs is None else pairs
    scored = scored_alone(graph, topology.with_ends_and_sums(graph, topology.ends(pairs)))  # settled by the ranking
    return ranking.percent_rank(scored, "hardness_raw", "_r").withColumn("hardness", rounded(F.col("_r"))).drop("_r")


def scored_alone(graph: Graph, own: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(stream_structured, degsum, stream_topology, hardness_raw, cn, confidence) of pairs that have their types, degrees and sums.

    What a pair has by itself, without its rank among others; u, v and n stay if they are there, types and degrees if named in ``also``.
    """
    ends = [c for c in ("u", "v", "n") if c in own.columns]
    kept = [*ends, "t_u", "t_v", "cn", "ra", "l3"]
    one = topology.structured_of(graph, own, kept).withColumnRenamed("value", "stream_structured")
    two = topology.topology_of(graph, one, topology.calibration(graph), [*ends, "stream_structured"])
    streams = {"structured": F.col("stream_structured"), "topology": F.col("value")}
    degsum = (F.col("k_u") + F.col("k_v")).alias("degsum")
    return two.select(*ends, *also, "stream_structured", degsum, F.col("value").alias("stream_topology"), F.coalesce("risk", F.lit(0.0)).alias("hardness_raw"), "cn", fusion.fuse(streams).alias("confidence"))


def scored_complement(graph: Graph) -> DataFrame:
    """:func:`frozen_pool` of all admissible non-edges.

    They are counted for the ranks of their hardness, which has four digits, and then listed;
    nothing else of them is kept.
    """
    ranks = settle(ranking.percent_ranks(_counts(graph, "hardness_raw"), "_r"), "ranks")
    own = scored_alone(graph, complement.pairs(graph, sums=True)).join(F.broadcast(ranks), F.col("hardness_raw").eqNullSafe(F.col("_v")))
    return own.withColumn("hardness", rounded(F.col("_r"))).drop("_r", "_v")


def _counts(graph: Graph, column: str) -> DataFrame:
    """(_v, n): how many admissible non-edges have each value of a column of :func:`scored_alone`."""
    counted = complement.counted(graph)
    if counted is None:
        counted = complement.pairs(graph, sums=True, names=False).withColumn("n", F.lit(1).cast("long"))
    return scored_alone(graph, counted).coalesce(COUNTING).groupBy(F.col(column).alias("_v")).agg(F.sum("n").alias("n"))


def first_of_complement(graph: Graph, n: int, by: str) -> DataFrame:
    """The first ``n`` of :func:`scored_complement` by ``confidence`` or ``hardness``, largest first, ties by (u, v); with hardness only if it is asked for.

    Counts of the score, which has four digits (so the driver gets 10,001 at most), tell the value that the last one
    has; pairs below it are left out where they are summed, and pairs without sums are listed only as far as the choice reaches.
    """
    if by not in ("confidence", "hardness"):
        raise ValueError(f"no choice by {by!r}")
    column = "confidence" if by == "confidence" else "hardness_raw"
    if not complement.bounded(graph):
        own = scored_complement(graph) if by == "hardness" else scored_alone(graph, complement.pairs(graph, sums=True))
        return ranking.top(own, n, F.desc(by))
    counts = settle(_counts(graph, column), "counts")
    if by == "hardness":
        ranks = ranking.percent_ranks(counts, "_r").select("_v", rounded(F.col("_r")).alias("_s"))
        counts = counts.join(ranks, "_v")
    else:
        counts = counts.withColumn("_s", F.col("_v"))
    values = settle(counts, "values")
    cut, found = None, 0
    for r in sorted(values.groupBy("_s").agg(F.sum("n").alias("n")).collect(), reverse=True):
        if found < n:
            cut, found = r["_s"], found + r["n"]
    reached = F.broadcast(values.where(F.col("_s") >= F.lit(cut)).select("_v", "_s"))
    classes = complement.degree_classes(graph)
    degrees = ("t_u", "t_v", "k_u", "k_v")
    of_class = settle(scored_alone(graph, classes, degrees).join(reached, F.col(column) == F.col("_v")).select(*degrees, "_s"), "classes")
    out = None
    for own, sent in complement.chosen(graph, n, of_class.where(F.col("_s") > F.lit(cut)), of_class.where(F.col("_s") == F.lit(cut))):
        own = scored_alone(graph, own).join(reached, F.col(column) == F.col("_v"))
        own = complement.named(own.withColumn("hardness", F.col("_s")) if by == "hardness" else own, sent).drop("_v", "_s")
        out = own if out is None else out.unionByName(own)
    return ranking.top(out, n, F.desc(by))


def arms(pool: DataFrame, known: DataFrame, n: int, seed: int = 0, positives: DataFrame | None = None, cap: float = selection.PSM_CAP) -> dict[str, DataFrame]:
    """The arms of the benchmark on one pool; ``known`` (u, v, either way round) are vetoed pairs.

    With ``positives`` (degsum) also the matched ones: ``counterfactual`` follows their
    degree sums over the whole vetoed pool, ``psm`` only up to the hardness ``cap``;
    ``eval_matched`` draws by degree, ``eval_matched_clean`` the same up to the cap.
    """
    vetoed = excluding(pool, known)
    draw = lambda df: candidates.hash_sample(df, n, seed)
    matched = {}
    if positives is not None:
        clean = vetoed.where(F.col("hardness") <= cap)
        matched = {
            "counterfactual": selection.psm(vetoed, positives, n, float("inf"), seed), "psm": selection.psm(vetoed, positives, n, cap, seed),
            "eval_matched": selection.degree_matched(vetoed, n, seed=seed), "eval_matched_clean": selection.degree_matched(clean, n, seed=seed),
        }
    return matched | {
        "random_raw": draw(pool), "random_veto": draw(vetoed), "topology_hard": selection.hard(vetoed, n), "topology_safe": ranking.top(vetoed, n, F.desc("stream_topology")),
        "stacked": selection.stacked(vetoed, n), "mixture": selection.mixture(vetoed, n, seed=seed),
    }


def injection(graph: Graph, hidden: DataFrame, max_pool: int | None, n: int, seed: int = 0, models: tuple[str, ...] = (), caps: tuple[float, ...] = (0.7, 0.5)) -> DataFrame:
    """(arm, injected, selected, share): what each arm selects of hidden positives put into the pool.

    The hidden edges are taken out of the graph first and bypass the veto. They enter the
    pool once, the way round that candidates have. Matched arms follow the degree sums of the
    training edges: ``counterfactual`` over the whole pool, ``psm[cap]`` up to a hardness.
    With ``models`` a fifth of the edges is held out as well, and each arm has the AUROC of
    each learner trained on its choice (``auroc_<model>``): the harm done downstream.
    """
    hidden = settle(graph.oriented(hidden).distinct(), "hidden")
    known = settle(excluding(graph.edges, hidden), "known")
    split = settle(random_split(known, 0.2 if models else 0.0, seed), "split")
    seen = Graph(graph.nodes, split.where("not is_test").select("u", "v"), graph.admissible, graph.name).settled()
    drawn = excluding(candidates.generate_candidates(seen, max_pool, seed), hidden, split.where("is_test"))
    pool = settle(frozen_pool(seen, max_pool, seed, settle(drawn.unionByName(hidden), "pool")), "scored")
    degrees = seen.degrees
    matched = seen.edges.join(degrees.select(F.col("id").alias("u"), F.col("k").alias("a")), "u").join(degrees.select(F.col("id").alias("v"), F.col("k").alias("b")), "v").select((F.col("a") + F.col("b")).alias("degsum"))
    chosen = arms(pool, seen.edges, n, seed)
    chosen["counterfactual"] = selection.psm(pool, matched, n, float("inf"), seed)
    chosen |= {f"psm[{cap}]": selection.psm(pool, matched, n, cap, seed) for cap in caps}
    chosen = {name: settle(picks.select("u", "v"), "picks") for name, picks in chosen.items()}
    marked = hidden.withColumn("injected", F.lit(1))
    total = hidden.agg(F.count(F.lit(1)).alias("injected"))
    out = None
    for name, picks in chosen.items():
        got = picks.join(marked, ["u", "v"], "left").agg(F.coalesce(F.sum("injected"), F.lit(0)).alias("selected"))
        row = got.join(F.broadcast(total)).select(F.lit(name).alias("arm"), "injected", "selected", rounded(ratio(F.col("selected"), F.col("injected"))).alias("share"))
        out = row if out is None else out.unionByName(row)
    if models:
        n_test = split.where("is_test").count()
        negatives = candidates.rejection_sample(graph, n_test, seed + 1)
        test = split.where("is_test").select("u", "v", F.lit(1).alias("y")).unionByName(negatives.select("u", "v", F.lit(0).alias("y")))
        harm = _downstream(seen, chosen, candidates.hash_sample(seen.edges, n, seed), test, n_test, models, seed)
        for model in models:
            out = out.join(harm.where(F.col("model") == model).select("arm", F.col("auroc").alias(f"auroc_{model}")), "arm")
    return out


def hidden_edges(graph: Graph, k: int, seed: int = 0) -> DataFrame:
    return graph.edges.orderBy(hash52(seed, F.col("u"), F.col("v")), "u", "v").limit(k)


def disjoint_split(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``side``: 0 or 1 if both ends fall on one side of the hash split, else null."""
    a, b = parity(seed, F.col("u")), parity(seed, F.col("v"))
    return pairs.withColumn("side", F.when(a == b, a))


def random_split(pairs: DataFrame, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    return pairs.withColumn("is_test", hash52(seed, F.col("u"), F.col("v")) % 1000 < round(test_share * 1000))


def inductive_split(graph: Graph, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Edges with ``regime``: both ends seen, one, or none; nodes are held out by hash."""
    out_of = lambda c: (hash52(seed, F.col(c)) % 1000 < round(test_share * 1000)).cast("int")
    return graph.edges.withColumn("regime", F.element_at(F.array(F.lit("seen"), F.lit("half"), F.lit("unseen")), out_of("u") + out_of("v") + 1))


def rule_ablation(scored: DataFrame, streams: list[str], label: str) -> DataFrame:
    """(left_out, auroc): fused from all streams, and from all but one."""
    out = None
    for left in [None, *streams]:
        kept = {s: F.col(f"stream_{s}") for s in streams if s != left}
        row = metrics.auroc(scored.select(F.col(label).alias("y"), fusion.fuse(kept).alias("score"))).select(F.lit(left or "none").alias("left_out"), "auroc")
        out = row if out is None else out.unionByName(row)
    return out


def signal_table(scored: DataFrame, signals: dict[str, str], label: str, random: str, hard: str) -> DataFrame:
    """(signal, coverage, auroc_random, auroc_hard, without): how well each signal tells ``label``.

    ``signals`` names score columns; ``random`` and ``hard`` are boolean columns that mark
    the negatives compared with. ``without`` is the change of the fused AUROC when the
    signal is left out. A signal that abstains counts as 0.5.
    """
    fused = lambda names: fusion.fuse({s: F.col(signals[s]) for s in names})
    area = lambda rows, score: metrics.auroc(rows.select(F.col(label).alias("y"), F.coalesce(score, F.lit(0.5)).alias("score")))
    whole, out = area(scored, fused(list(signals))).withColumnRenamed("auroc", "_all"), None
    for name, column in signals.items():
        is_positive = F.col(label) == 1
        parts = [
            metrics.coverage(scored, [column]).select("coverage"),
            area(scored.where(is_positive | F.col(random)), F.col(column)).withColumnRenamed("auroc", "auroc_random"),
            area(scored.where(is_positive | F.col(hard)), F.col(column)).withColumnRenamed("auroc", "auroc_hard"),
            area(scored, fused([s for s in signals if s != name])).withColumnRenamed("auroc", "_less"), whole,
        ]
        row = parts[0]
        for p in parts[1:]:
            row = row.join(F.broadcast(p))  # one row each
        row = row.select(F.lit(name).alias("signal"), "coverage", "auroc_random", "auroc_hard", rounded(F.col("_less") - F.col("_all")).alias("without"))
        out = row if out is None else out.unionByName(row)
    return out


def seed_summary(results: DataFrame, baseline: str = "random_veto") -> DataFrame:
    """(arm, model, auroc, delta): means over seeds, and the difference to a baseline arm."""
    mean = results.groupBy("arm", "model").agg(rounded(F.avg("auroc")).alias("auroc"))
    base = mean.where(F.col("arm") == baseline).select("model", F.col("auroc").alias("_b"))
    return mean.join(base, "model", "left").select("arm", "model", "auroc", rounded(F.col("auroc") - F.col("_b")).alias("delta"))


def learner(name: str, seed: int = 0):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    if name == "rf":
        return RandomForestClassifier(numTrees=200, maxDepth=10, seed=seed)
    if name == "gbt":
        return GBTClassifier(maxIter=50, seed=seed)
    if name == "lr":
        return LogisticRegression()
    raise ValueError(f"learner {name!r}")


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], model: str = "rf", seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predictions (y, score, and the columns ``carry``) of a learner on the test rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=features, outputCol="features")
    fitted = learner(model, seed).setLabelCol("y").setFeaturesCol("features").fit(assemble.transform(train.na.fill(0.0)).select("y", "features"))
    return fitted.transform(assemble.transform(test.na.fill(0.0))).select(*carry, "y", vector_to_array("probability")[1].alias("score"))


def _featurizer(seen: Graph, kind: str):
    """A function from pairs (u, v, y) to features, and their names."""
    if kind == "spectral":
        vectors, size = manifold.spectral_embeddings(seen), manifold.DIMENSIONS
        names = [f"f{i}" for i in range(size)]
        return lambda p: manifold.pair_vectors(p, vectors).select("u", "v", "y", *[F.coalesce(F.try_element_at("rep", F.lit(i + 1)), F.lit(0.0)).alias(f"f{i}") for i in range(size)]), names
    if kind == "topological":
        return lambda p: topology.pair_features(seen, p), list(FEATURES)
    raise ValueError(f"featurizer {kind!r}")


def measures(predictions: DataFrame, n_positive: int, n_negative: int, hits: int = 100, least: int = 10) -> DataFrame:
    """One row of AUROC, average precision, hits at both ends, and the AUROC of pairs with neighbours.

    ``predictions`` has u, v, y, score and ``linked`` (both ends have neighbours in the
    training graph). Hits are the share of positives among the highest and of negatives
    among the lowest scores; ``auroc_linked`` is null for ``least`` rows or fewer.
    """
    k = min(hits, n_positive, n_negative)
    key = predictions.withColumn("_key", F.concat_ws(" ", "u", "v"))
    linked = predictions.where("linked")
    enough = linked.agg((F.count(F.lit(1)) > least).alias("_enough"))
    parts = [
        metrics.average_precision(predictions), metrics.hits_at_k(key, k, "_key").select(F.col("hits").alias("hits_high")), metrics.hits_at_k(key, k, "_key", lowest=True).select(F.col("hits").alias("hits_low")),
        metrics.auroc(linked).withColumnRenamed("auroc", "_linked"), enough,
    ]
    out = metrics.auroc(predictions)
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out.select("auroc", "average_precision", "hits_high", "hits_low", F.when(F.col("_enough"), F.col("_linked")).alias("auroc_linked"))


def run_benchmark(graph: Graph, gold: DataFrame | None = None, n: int = 1000, max_pool: int = 20_000, models: tuple[str, ...] = ("rf",), arm_names: tuple[str, ...] = ("random_veto", "topology_hard", "stacked"), seed: int = 0, featurizer: str = "topological") -> DataFrame:
    """(arm, model, and :func:`measures`) of learners trained on each arm's negatives.

    Features and negatives come from the graph of training edges alone. There are as many
    test positives as test negatives.
    """
    split = settle(random_split(graph.edges, 0.2, seed), "split")
    seen = Graph(graph.nodes, split.where("not is_test").select("u", "v"), graph.admissible, graph.name).settled()
    n_test = split.where("is_test").count()
    if gold is not None:
        negatives = settle(candidates.hash_sample(candidates.non_edges(graph, gold.select(F.col("lo").alias("u"), F.col("hi").alias("v"))), n_test, seed), "negatives")
    else:
        negatives = candidates.rejection_sample(graph, n_test, seed + 1)
    n_test = min(n_test, negatives.count())
    held = candidates.hash_sample(split.where("is_test").select("u", "v"), n_test, seed)
    test_pairs = held.withColumn("y", F.lit(1)).unionByName(negatives.select("u", "v", F.lit(0).alias("y")))
    positives = candidates.hash_sample(seen.edges, n, seed)
    pool = settle(frozen_pool(seen, max_pool, seed), "pool")
    return _downstream(seen, {name: arms(pool, seen.edges, n, seed)[name] for name in arm_names}, positives, test_pairs, n_test, models, seed, featurizer)


def _downstream(seen: Graph, chosen: dict[str, DataFrame], positives: DataFrame, test_pairs: DataFrame, n_test: int, models: tuple[str, ...], seed: int, featurizer: str = "topological") -> DataFrame:
    """(arm, model, measures): what learners trained on each arm's choice of negatives make of the test pairs."""
    featurize, names = _featurizer(seen, featurizer)
    degrees = seen.degrees.where("k > 0").select("id", F.lit(True).alias("_in"))
    test = featurize(test_pairs)
    for end in ("u", "v"):
        test = test.join(degrees.select(F.col("id").alias(end), F.col("_in").alias(f"_{end}")), end, "left")
    test = settle(test.withColumn("linked", F.col("_u").isNotNull() & F.col("_v").isNotNull()).drop("_u", "_v"), "test")
    out = None
    for arm, negatives in chosen.items():
        train = settle(featurize(positives.select("u", "v", F.lit(1).alias("y")).unionByName(negatives.select("u", "v", F.lit(0).alias("y")))), "train")
        for model in models:
            predictions = settle(fit_predict(train, test, names, model, seed, ("u", "v", "linked")), "predictions")
            row = measures(predictions, n_test, n_test).select(F.lit(arm).alias("arm"), F.lit(model).alias("model"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def out_of_fold(rows: DataFrame, features: list[str], folds: int = 5, model: str = "lr", seed: int = 0) -> DataFrame:
    """Each row (u, v, y, features...) scored by a learner that didn't see its fold."""
    dealt = settle(rows.withColumn("_f", fold(seed, folds, F.col("u"), F.col("v"))), "dealt")
    out = None
    for k in range(folds):
        part = fit_predict(dealt.where(F.col("_f") != k), dealt.where(F.col("_f") == k), features, model, seed)
        out = part if out is None else out.unionByName(part)
    return out


def judge_report(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(verdict, n, hit_rate): share of each verdict's pairs that independent evidence knows."""
    known = evidence.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct().withColumn("_hit", F.lit(1.0))
    own = verdicts.join(known, (F.least("u", "v") == F.col("lo")) & (F.greatest("u", "v") == F.col("hi")), "left")
    return own.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.coalesce("_hit", F.lit(0.0)))).alias("hit_rate"))

