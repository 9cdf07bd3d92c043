"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. The model of category k sees the text
features and the probabilities of categories 1..k-1. In training those come from
models that did not see the row (out-of-fold), so that later models learn from
probabilities as uncertain as the ones they meet when scoring.

Features are 0/1: whole words and word beginnings of 4 to 6 letters, which carry
over to unseen inflections. Spark counts them over the labelled sample, by fold, and
keeps those that are surely more frequent in the last category (chi-square of ``min_chi``
at least). A model that leaves a fold out has only the features that the other
folds choose, so no probability out of a fold rests on the fold's own labels.

The chain rejects where the last probability reaches a threshold: the one with the best
F0.5 of the out-of-fold probabilities of the training rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import id_and_text, map_rows
from paceforge.llm.linear import Sparse, fit_logistic, sigmoid

_PREFIXES = (4, 5, 6)
SHORT = 400  # features of some 200 different words
TWINS = 8
_EDGE = " \t\n\r\"'`.,;:!?()[]{}<>*%$&#|/\\+-_=~"


def features(text: str | None) -> set[str]:
    """Distinct words in lower case without punctuation at their ends, and their beginnings (marked by ^)."""
    bare = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    bare.discard("")
    out = set(bare)
    for n in _PREFIXES:
        out.update("^" + w[:n] for w in bare if len(w) > n)
    return out


@dataclass
class Chain:
    """A fitted chain: plain numbers, a few hundred kB at most, so that it travels in the task closure."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    dense: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def lookup(self, text: str | None) -> list[int]:
        """Vocabulary numbers of a whole text's features."""
        bare = {w.strip(_EDGE) for w in set((text or "").lower().split())}
        bare.discard("")
        vocabulary = self.vocabulary
        found = {vocabulary[w] for w in vocabulary.keys() & bare}
        for n in _PREFIXES:
            found.update(vocabulary[p] for p in {"^" + w[:n] for w in bare if len(w) > n} & vocabulary.keys())
        return sorted(found)

    def probabilities(self, text: str | None) -> list[float]:
        found, earlier = self.lookup(text), []
        for w, v in zip(self.weights, self.dense, strict=True):
            z = float(w[found].sum() + v[0] + np.dot(v[1:], earlier))
            earlier.append(float(sigmoid(np.float64(z))))
        return earlier


#: From the label table alone: abuse in texts marked as good and as bad, then any.
CATEGORIES = {"prose_abuse": "toxic = 1 and quality = 1", "junk_abuse": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: dict[str, str], max_rows: int, folds: int, keep: Column | None) -> DataFrame:
    """(doc_id, text, fold, y array<int>): at most ``max_rows`` labelled rows, the smallest by hash of the id, so any run takes the same ones.

    Rows without a value for the last category are left out; an earlier category that is null counts as not given.
    """
    marks = [F.expr(e).cast("int") for e in categories.values()]
    y = labels.select(F.col(id_col).alias("doc_id"), *(m.alias(f"y{k}") for k, m in enumerate(marks))).where(f"doc_id is not null and y{len(marks) - 1} is not null")
    y = y.groupBy("doc_id").agg(*(F.coalesce(F.max(f"y{k}"), F.lit(0)).alias(f"y{k}") for k in range(len(marks))))
    y = y.where(keep) if keep is not None else y
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    y = y.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(folds)).cast("int").alias("fold"), F.array(*(f"y{k}" for k in range(len(marks)))).alias("y"))
    return id_and_text(docs, id_col, text_col).join(F.broadcast(y), "doc_id")  # bound: max_rows rows of some 20 bytes


def _chosen(a: np.ndarray, b: np.ndarray, worth: np.ndarray, n1: int, n0: int, min_chi: float) -> np.ndarray:
    """Which features, in ``a`` of ``n1`` rows of the category and ``b`` of ``n0`` others, are surely more frequent in it: chi-square with 1/2 added to each cell.

    The ``a`` rows must be worth one and a half short texts together, where one of n > ``SHORT`` features is
    worth ``SHORT`` / n of it: any of its many features may be there by chance.
    """
    p, q, r, s = a + 0.5, b + 0.5, n1 - a + 0.5, n0 - b + 0.5
    chi = (n1 + n0) * (p * s - q * r) ** 2 / ((p + q) * (r + s) * (p + r) * (q + s))
    return (chi >= min_chi) & (a * n0 > b * n1) & (worth >= 1.5)


def _copied(rows: list[list[int]], width: int) -> np.ndarray:
    """Features that over ``TWINS`` features of few rows share exactly the same rows: those rows are copies of each other and tell no more than one."""
    held: list[list[int]] = [[] for _ in range(width)]
    for n, cols in enumerate(rows):
        for c in cols:
            held[c].append(n)
    sets = [tuple(h) for h in held]
    often = Counter(sets)
    return np.array([1 < len(s) <= 3 and often[s] > TWINS for s in sets], bool)


def best_threshold(p: np.ndarray, y: np.ndarray, low: float = 0.25, high: float = 0.5) -> float:
    """The value between ``low`` and ``high`` with the best F0.5, as losing a clean text is worse than keeping a toxic one; the largest of several."""
    tries = np.round(np.arange(high, low - 1e-9, -0.02), 2)
    score = [1.25 * (y[p >= t] == 1).sum() / max(1, (p >= t).sum() + 0.25 * y.sum()) for t in tries]
    return float(tries[int(np.argmax(score))])


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: dict[str, str] | None = None,
    max_rows: int = 16000,
    n_features: int = 6000,
    min_chi: float = 10.8,
    l2: float = 0.3,
    folds: int = 5,
    keep: Column | None = None,
) -> Chain:
    """Fit a chain over ``categories`` (name -> SQL condition over the label row); the last one decides, and sees the out-of-fold probabilities of the others.

    By default the first two part the toxic rows by the quality mark of the same table.
    ``max_rows`` bounds the labelled rows used, and with ``n_features`` what reaches the
    driver: numbers of features, never texts. ``keep`` (an expression over doc_id)
    restricts the rows to learn from. Without labelled rows of both classes of the last
    category the chain gives the classes' base rate.
    """
    categories = categories or CATEGORIES
    names = list(categories)
    sample = labelled_sample(docs, labels, id_col, text_col, categories, max_rows, folds, keep)
    kind = dict(sample.dtypes)["doc_id"]
    totals = np.zeros((folds, 2), np.int64)
    for r in sample.groupBy("fold", F.element_at("y", -1).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["fold"], r["y"]] = r["n"]
    (n0, n1), links = totals.sum(axis=0).tolist(), range(len(names))
    if not n1 or not n0:
        rate = 20.0 if n1 else -20.0
        return Chain(names, {}, [np.zeros(0) for _ in links], [np.array([rate] + [0.0] * k) for k in links])

    def listed():
        def one(r):
            found = features(r["text"])
            return [(f, r["fold"], r["y"][-1], min(1.0, SHORT / len(found))) for f in found]

        return one

    counts = map_rows(sample, "feature string, fold int, y int, worth double", listed)
    each = [F.count_if((F.col("fold") == f) & (F.col("y") == k)).alias(f"n{f}_{k}") for f in range(folds) for k in (0, 1)]
    each += [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("y") == 1), F.round("worth", 6))), F.lit(0.0)).alias(f"w{f}") for f in range(folds)]
    a = sum(F.col(f"n{f}_1") for f in range(folds))
    b = sum(F.col(f"n{f}_0") for f in range(folds))
    # a first choice that holds all that any fold's own choice can: the surest n_features among those seen twice and leaning to the category
    lean = (a * n0 - b * n1) / F.sqrt((a + b) * 1.0)
    best = counts.groupBy("feature").agg(*each).where((a >= 2) & (a * n0 > b * n1)).orderBy(F.desc(lean), "feature").limit(n_features).collect()
    seen = np.array([[[r[f"n{f}_{k}"] for k in (0, 1)] for f in range(folds)] for r in best], np.int64).reshape(len(best), folds, 2)
    worth = np.array([[r[f"w{f}"] for f in range(folds)] for r in best], float).reshape(len(best), folds)
    use = {}
    for f in [None, *range(folds)]:
        own = [g for g in range(folds) if g != f]
        (b_own, a_own), (m0, m1) = seen[:, own].sum(axis=1).T, totals[own].sum(axis=0).tolist()
        use[f] = _chosen(a_own, b_own, worth[:, own].sum(axis=1), m1, m0, min_chi)
    chain = Chain(names, {r["feature"]: i for i, r in enumerate(best)})

    def start():
        return lambda r: [(r["doc_id"], r["fold"], r["y"], np.array(chain.lookup(r["text"]), np.int32).tobytes())]

    rows = sorted(map_rows(sample, f"doc_id {kind}, fold int, y array<int>, cols binary", start).collect(), key=lambda r: (r["doc_id"], bytes(r["cols"])))
    y, fold = np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    cols = [np.frombuffer(bytes(r["cols"]), np.int32) for r in rows]
    del rows
    free = ~_copied([c.tolist() for c, toxic in zip(cols, y[:, -1], strict=True) if toxic], len(best))
    any_use = np.flatnonzero(np.any(list(use.values()), axis=0) & free)
    use = {f: u[any_use] for f, u in use.items()}
    chain = Chain(names, {best[i]["feature"]: n for n, i in enumerate(any_use.tolist())})
    place = np.full(len(best), -1)
    place[any_use] = np.arange(len(any_use))
    x = Sparse([p[p >= 0] for p in (place[c] for c in cols)], len(any_use))
    earlier = np.ones((len(cols), 1))
    for k in links:
        w, v = fit_logistic(x, earlier, y[:, k], l2=l2, columns=use[None])
        chain.weights.append(w)
        chain.dense.append(v)
        held = np.zeros(len(cols))
        for f in range(folds):
            wf, vf = fit_logistic(x, earlier, y[:, k], fold != f, l2, columns=use[f])
            held[fold == f] = sigmoid(x.dot(wf) + earlier @ vf)[fold == f]
        earlier = np.column_stack([earlier, held])
    chain.threshold = best_threshold(earlier[:, -1], y[:, -1])
    return chain


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """One row per document: doc_id, p_<category> for each, rejected (the last link reaches the threshold, by default the chain's).

    Whole texts are read. Null and empty texts have no feature and get the intercept's
    probability. Repeated rows give repeated results; a null id stays null.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    columns = ", ".join(f"p_{c} double" for c in chain.categories)
    scored = map_rows(rows, f"doc_id {kind}, {columns}", lambda: lambda r: [(r["doc_id"], *chain.probabilities(r["text"]))])
    return scored.withColumn("rejected", F.col(f"p_{chain.categories[-1]}") >= (chain.threshold if threshold is None else threshold))


def drop_toxic(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected; one pass, no join.

    Null and empty texts have no feature: they stay unless toxic texts are the rule among the
    labelled ones. Very long texts are read whole; repeated rows and null ids are rows like any other.
    """
    least = chain.threshold if threshold is None else threshold
    keep = F.udf(lambda text: chain.probabilities(text)[-1] < least, "boolean", useArrow=True)
    return docs.where(keep(F.col(text_col)))
