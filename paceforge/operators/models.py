"""Learned models: clusters of laps and drivers, podium classifiers, and how well they do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    d = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(d).transform(d)


def best_clusters(df: DataFrame, columns: list[str], most: int = 5, seed: int = 42) -> DataFrame:
    """k-means with the k of the best silhouette (2 to ``most``) and the first two principal components."""
    d = scaled(df, columns).persist()
    fits = [(ClusteringEvaluator().evaluate(m.transform(d)), k, m) for k in range(2, most + 1) for m in [KMeans(k=k, seed=seed).fit(d)]]
    model = max(fits, key=lambda f: (f[0], -f[1]))[2]
    out = PCA(k=2, inputCol="features", outputCol="pc").fit(d).transform(model.transform(d))
    pc = vector_to_array("pc")
    return out.select(*df.columns, F.col("prediction").alias("cluster"), pc[0].alias("pc1"), pc[1].alias("pc2"))


def podium_chances(train: DataFrame, test: DataFrame, columns: list[str], label: str, kind: str = "logistic") -> DataFrame:
    """Chance of ``label`` = 1 on rows later than all that were learned from."""
    make = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    learner = LogisticRegression(labelCol=label, maxIter=50, regParam=0.01) if kind == "logistic" else GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=42)
    model = learner.fit(make.transform(train))
    return model.transform(make.transform(test)).select(*test.columns, vector_to_array("probability")[1].alias("chance"))


def anomaly_flags(df: DataFrame, columns: list[str], contamination: float = 0.04) -> DataFrame:
    """The ``contamination`` share of rows farthest from the centre in standardised units."""
    d = scaled(df, columns).withColumn("distance", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x))
    limit = d.agg(F.percentile("distance", F.lit(1 - contamination)).alias("limit"))
    return d.join(limit, F.lit(True)).select(*df.columns, F.round("distance", 6).alias("distance"), (F.col("distance") > F.col("limit")).alias("anomaly"))


# ---- logistic regression, all left-out folds side by side


def fold_sums(x: np.ndarray, y: np.ndarray, own: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss at each fold's weights, over the rows outside the fold. x has a column of ones."""
    z = np.clip(x @ beta.T, -500, 500)
    p = 1 / (1 + np.exp(-z))
    counts = own[:, None] != np.arange(len(beta))
    grad = ((p - y[:, None]) * counts).T @ x
    curve = (p * (1 - p) * counts).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return grad, curve.reshape(len(beta), x.shape[1], x.shape[1])


def leave_out_logistic(df: DataFrame, columns: list[str], label: str, fold: str, penalty: float = 1.0, rounds: int = 30, max_folds: int = 10_000) -> DataFrame:
    """Adds ``chance`` and ``predicted``: each row is judged by the model of all rows outside its fold.

    Every fold is an L2 regression (half the squared weights times ``penalty`` beside the summed log
    loss; the intercept is free, and bounded at 50 where a fold leaves one class only). All folds take Newton steps
    together: a pass over the rows adds up gradient and curvature of every fold in each task, Spark adds the tasks
    up, and only folds x (p + 1) x (p + 2) numbers reach the driver; more than ``max_folds`` folds are
    refused. Separable data stay finite by the penalty. A fold of one row each is leave-one-out.
    Rows with a null in the columns, label or fold are left out; label is 0 or 1. The rows are kept, as each
    pass would make them anew.
    """
    rows = df.dropna(subset=[*columns, label, fold]).persist()
    folds = [r[0] for r in rows.select(fold).distinct().limit(max_folds + 1).collect()]
    if len(folds) > max_folds:
        raise ValueError(f"more than {max_folds} folds")
    place, p = {f: i for i, f in enumerate(sorted(folds))}, len(columns)
    moments = rows.agg(*(f(c) for c in columns for f in (F.avg, F.stddev_pop))).first()
    centre = np.array([m or 0.0 for m in moments[0::2]], float)
    scale = np.array([s if s else 1.0 for s in moments[1::2]], float)
    beta, step_rows = np.zeros((len(folds), p + 1)), max(1, 4_000_000 // max(1, len(folds)))
    cost = penalty * np.diag([0.0, *(1 / scale**2)])  # the weights are penalised in the columns' own units
    used = rows.select(*columns, F.col(label).cast("double").alias("__y"), F.col(fold).alias("__fold"))

    def scaled_rows(pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(pdf)), (pdf[columns].to_numpy(float) - centre) / scale])

    def one_pass(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grad, curve = np.zeros_like(now), np.zeros((len(now), p + 1, p + 1))
            for pdf in frames:
                for at in range(0, len(pdf), step_rows):
                    part = pdf.iloc[at : at + step_rows]
                    g, c = fold_sums(scaled_rows(part), part["__y"].to_numpy(), part["__fold"].map(place).to_numpy(), now)
                    grad, curve = grad + g, curve + c
            both = np.concatenate([grad, curve.reshape(len(now), -1)], axis=1).ravel()
            yield pd.DataFrame({"k": np.arange(len(both)), "v": both})

        sums = used.mapInPandas(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(len(now) * (p + 1) * (p + 2))
        out[sums["k"]] = sums["v"]
        out = out.reshape(len(now), -1)
        return out[:, : p + 1], out[:, p + 1 :].reshape(-1, p + 1, p + 1)

    for _ in range(rounds if folds else 0):
        grad, curve = one_pass(beta)
        move = np.linalg.solve(curve + cost + 1e-10 * np.eye(p + 1), (grad + beta @ cost)[:, :, None])[:, :, 0]
        move /= np.maximum(1, np.abs(move).max(1, keepdims=True) / 5)
        beta = np.clip(beta - move, -50, 50)
        if np.abs(move).max() < 1e-9:
            break

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            z = (scaled_rows(pdf) * beta[pdf[fold].map(place).to_numpy()]).sum(1) if len(pdf) else np.zeros(0)
            yield pdf.assign(chance=1 / (1 + np.exp(-z)))

    out = rows.mapInPandas(judge, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", chance double")
    return out.withColumn("predicted", (F.col("chance") >= 0.5).cast("int"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """How many rows of each label got each prediction."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


# ---- isolation forest


def grow_tree(x: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column or -1, cut, left, right) of a random tree; a leaf's cut is its depth plus the mean depth of what it holds."""
    nodes: list[tuple[int, float, int, int]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, depth + mean_depth(len(part)), -1, -1))
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.flatnonzero(high > low)
        if depth < height and len(wide):
            c = int(rng.choice(wide))
            cut = float(rng.uniform(low[c], high[c]))
            under = part[:, c] < cut
            left, right = add(part[under], depth + 1), add(part[~under], depth + 1)
            nodes[at] = (c, cut, left, right)
        return at

    add(x, 0)
    return nodes


def mean_depth(n: int) -> float:
    """Mean depth at which a search in a random tree of n rows ends."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, columns: list[str], contamination: float = 0.04, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: easier to isolate) and ``anomaly`` for the ``contamination`` share of highest scores.

    A row is dealt to one tree by a hash of its columns, and each tree learns from the ``sample`` rows of its
    own with the smallest second hash, so the trees are grown in parallel from ``trees`` x ``sample`` rows at
    most; equal rows count once there. The trees (their size is bounded) travel to the tasks, which score whole batches. Where fewer rows
    than ``trees`` x 2 are there, trees share rows. Rows with a null or NaN in the columns have null in both.
    The limit is an approximate percentile with an error of a millionth of the rows.
    """
    values = [F.col(c).cast("double") for c in columns]
    whole = F.forall(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    known = df.where(whole).select(*(v.alias(f"x{i}") for i, v in enumerate(values))).distinct()
    xs = [f"x{i}" for i in range(len(columns))]
    dealt = known.withColumns({"tree": F.pmod(F.xxhash64(*xs, F.lit(seed)), F.lit(trees)).cast("int"), "turn": F.xxhash64(*xs, F.lit(seed + 1))})
    few = known.limit(2 * trees * sample).count() < trees * sample
    if few:  # bounded: every tree then draws from all rows
        dealt = known.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("turn", F.xxhash64(*xs, "tree", F.lit(seed)))
    w = Window.partitionBy("tree").orderBy("turn", *xs)
    picked = dealt.withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["turn", *xs])[xs].to_numpy()
        nodes = grow_tree(x, np.random.default_rng([seed, int(key[0])]), max(1, int(np.ceil(np.log2(max(len(x), 2))))))
        return pd.DataFrame([(key[0], len(x), *map(list, zip(*nodes, strict=True)))], columns=["tree", "n", "column", "cut", "left", "right"])

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, n int, column array<int>, cut array<double>, left array<int>, right array<int>").toPandas()
    forest = [(np.array(t["column"]), np.array(t["cut"]), np.array(t["left"]), np.array(t["right"])) for _, t in grown.sort_values("tree").iterrows()]
    usual = float(np.mean([mean_depth(n) for n in grown["n"]])) if len(grown) else 1.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pdf[columns].to_numpy(float)
            total = np.zeros(len(x))
            for column, cut, left, right in forest:
                at = np.zeros(len(x), int)
                while (inner := column[at] >= 0).any():
                    c = np.where(inner, column[at], 0)
                    down = np.where(x[np.arange(len(x)), c] < cut[at], left[at], right[at])
                    at = np.where(inner, down, at)
                total += cut[at]
            yield pdf.assign(score=2.0 ** (-total / max(len(forest), 1) / (usual or 1.0)))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    scored = df.where(whole).mapInPandas(score, kinds + ", score double")
    limit = scored.agg(F.percentile_approx("score", 1 - contamination, 1_000_000).alias("limit"))
    out = scored.join(F.broadcast(limit), F.lit(True)).withColumn("anomaly", F.col("score") > F.col("limit")).drop("limit")  # one row
    rest = df.where(~F.coalesce(whole, F.lit(False))).withColumns({"score": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("boolean")})
    return out.unionByName(rest)


# ---- agreement of clusterings, time-ordered evaluation


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two clusterings of the same rows, from pair counts of their contingency table; null where it is 0 / 0."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(c))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("rows"))
    d = both.join(side("a"), F.lit(True)).join(side("b"), F.lit(True))  # one row each
    by_chance, most = F.col("a") * F.col("b") / pairs(F.col("rows")), (F.col("a") + F.col("b")) / 2
    return d.select(F.col("rows").cast("bigint").alias("n"), F.when(F.abs(most - by_chance) > 1e-12, F.round((F.col("same") - by_chance) / (most - by_chance), 6)).otherwise(F.when(F.col("same") == most, 1.0)).alias("rand"))


def permuted(df: DataFrame, column: str, id_columns: list[str], rows_each: int = 1000, total: int = 1, seed: int = 42) -> DataFrame:
    """The rows with the values of a column passed on in rings of about ``rows_each`` rows, in the order of a hash of the ids.

    A permutation of all values that no task sees whole.
    """
    ring = F.pmod(F.xxhash64(*id_columns, F.lit(seed)), F.lit(max(1, total // rows_each)))
    w = Window.partitionBy("__ring").orderBy(F.xxhash64(*id_columns, F.lit(seed + 1)), *id_columns)
    everyone = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = df.withColumn("__ring", ring).withColumns({"__next": F.lead(column).over(w), "__last": F.row_number().over(w) == F.count(F.lit(1)).over(everyone), "__first": F.first(column).over(everyone)})
    return held.withColumn(column, F.when(F.col("__last"), F.col("__first")).otherwise(F.col("__next"))).drop("__ring", "__next", "__last", "__first")


def expanding_splits(order: list, splits: int) -> list[tuple[list, list]]:
    """Training and test values of each split: test blocks of equal size at the end, everything earlier trains."""
    order, size = sorted(order), max(1, len(order) // (splits + 1))
    starts = [len(order) - size * (splits - i) for i in range(splits)]
    return [(order[:s], order[s : s + size]) for s in starts if s > 0]


def time_ordered_scores(df: DataFrame, columns: list[str], label: str, order: str, baseline: str, id_columns: list[str], splits: int = 3, seed: int = 42) -> DataFrame:
    """For each split by time: rows, mean absolute error of boosted trees, of the training mean and of a baseline column, and what each column is worth.

    Rows: split, measure ('model', 'mean', the baseline's name, or 'without ' and a column), mae, n. A column's worth is how
    much larger the error is with its values permuted within the test block: measure 'without x' less 'model'.
    Few distinct values of ``order`` (seasons) are expected: they are listed on the driver.
    """
    rows = df.dropna(subset=[*columns, label, order])
    make, out = VectorAssembler(inputCols=columns, outputCol="features"), None
    for number, (past, now) in enumerate(expanding_splits([r[0] for r in rows.select(order).distinct().collect()], splits), 1):
        train, test = rows.where(F.col(order).isin(past)), rows.where(F.col(order).isin(now))
        model = GBTRegressor(labelCol=label, maxIter=5, maxDepth=3, seed=seed).fit(make.transform(train))
        usual, n = train.agg(F.avg(label)).first()[0], test.count()
        guess = lambda d: model.transform(make.transform(d)).select(label, F.col("prediction"))  # noqa: E731, B023
        measured = [("model", guess(test)), ("mean", test.select(label, F.lit(usual).alias("prediction"))), (baseline, test.select(label, F.col(baseline).alias("prediction")))]
        measured += [(f"without {c}", guess(permuted(test, c, id_columns, total=n, seed=seed))) for c in columns]
        for name, d in measured:
            one = d.agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("mae"), F.count(F.lit(1)).alias("n")).select(F.lit(number).alias("split"), F.lit(name).alias("measure"), F.round("mae", 6).alias("mae"), "n")
            out = one if out is None else out.unionByName(one)
    return out
