"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its emission score reads features of the line and of its
two neighbours; transition scores tie adjacent labels. Forward-backward gives each
line's marginal; the share of the document's length that is good, and its worst
stretch, give the document's quality through a fitted logistic curve.

Only document labels exist, so training alternates: lines start with the label of
their document, then lines of bad documents that the fitted field finds good are
relabelled (at least the worst line of a bad document stays bad), and it is refitted.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import bucket_of, id_and_text, map_rows

_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_STOPS = bytes(b for b in range(256) if b not in b".,;:?'\"-")
_MARKS = bytes(b for b in range(256) if b not in b"!*%$&#|@^~=+<>{}[]_/\\")
N_OWN = 8


def line_features(line: bytes) -> tuple[float, ...]:
    """Shares of upper case, marks, stops and digits; repeats of the word before; distinct words; word length; length."""
    size = max(1, len(line))
    ws = line.split()
    n = max(1, len(ws))
    same = sum(map(eq, ws, ws[1:])) / n
    return (
        len(line.translate(None, _UPPER)) / size, len(line.translate(None, _MARKS)) / size, len(line.translate(None, _STOPS)) / size,
        len(line.translate(None, _DIGIT)) / size, same, len(set(ws)) / n if n > 8 else 1.0, min(size / n, 30) / 10, np.log1p(n) / 4,
    )


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3 N_OWN) features of own, previous and next line; line lengths in bytes plus one."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    memo: dict[bytes, tuple] = {}
    own = np.array([memo[x] if x in memo else memo.setdefault(x, line_features(x)) for x in lines])
    before = np.vstack([np.zeros((1, N_OWN)), own[:-1]])
    after = np.vstack([own[1:], np.zeros((1, N_OWN))])
    return np.hstack([own, before, after]), np.array([len(x) + 1.0 for x in lines])


def forward_backward(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines x 2), expected transitions (2 x 2) and log-partition of one chain."""
    n = len(emit)
    shift = emit.max(axis=1)
    e, t = np.exp(emit - shift[:, None]), np.exp(trans)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    a = e[0]
    for i in range(n):
        if i:
            a = (a @ t) * e[i]
        scale[i] = a.sum()
        a = a / scale[i]
        alpha[i] = a
    b = beta[-1]
    for i in range(n - 2, -1, -1):
        b = t @ (e[i + 1] * b) / scale[i + 1]
        beta[i] = b
    pairs = np.einsum("ni,ij,nj->ij", alpha[:-1] / scale[1:, None], t, e[1:] * beta[1:]) if n > 1 else np.zeros((2, 2))
    return alpha * beta, pairs, float(np.log(scale).sum() + shift.sum())


def packed_marginals(emits: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """forward_backward over many chains, one step of all chains at a time."""
    order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
    sizes = np.array([len(emits[i]) for i in order])
    n, steps = len(order), int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than t
    at = np.concatenate([[0], np.cumsum(live)])  # step s of chain k is row at[s] + k: as many rows as there are lines
    flat = np.empty((at[-1], 2))
    for k, i in enumerate(order):
        flat[at[: sizes[k]] + k] = emits[i]
    shift = flat.max(axis=1)
    e, t = np.exp(flat - shift[:, None]), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    for s in range(steps):
        a0, m = at[s], live[s]
        a = (alpha[at[s - 1] : at[s - 1] + m] @ t) * e[a0 : a0 + m] if s else e[:m]
        scale[a0 : a0 + m] = a.sum(axis=1)
        alpha[a0 : a0 + m] = a / scale[a0 : a0 + m, None]
    pairs = np.zeros((2, 2))
    for s in range(steps - 2, -1, -1):
        a0, a1, m = at[s], at[s + 1], live[s + 1]
        ahead = e[a1 : a1 + m] * beta[a1 : a1 + m] / scale[a1 : a1 + m, None]
        beta[a0 : a0 + m] = ahead @ t.T
        pairs += t * (alpha[a0 : a0 + m].T @ ahead)
    post = alpha * beta
    out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
    for k, i in enumerate(order):
        out[i] = post[at[: sizes[k]] + k]
    return out, pairs, float(np.log(scale).sum() + shift.sum())


@dataclass
class QualityField:
    """Fitted numbers only: standardisation, emission and transition weights, document curve."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))]) @ self.weights
        return np.column_stack([-z / 2, z / 2])  # bad, good

    def good(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the lines' lengths."""
        x, sizes = document_features(text)
        return forward_backward(self.emissions(x), self.trans)[0][:, 1], sizes

    def score(self, text: str | None) -> tuple[float, float]:
        """(quality, length-weighted P(good))."""
        good, sizes = self.good(text)
        return _curve(self.curve, *_shares(good, sizes))


def _shares(good: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    return float((good * sizes).sum() / sizes.sum()), float(np.log1p(((1 - good) * sizes).sum()))


def _curve(curve: np.ndarray, share: float, bad_bytes: float) -> tuple[float, float]:
    z = curve @ np.array([share, bad_bytes, 1.0])
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), share


def fit_field(x: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, rounds: int = 2, steps: int = 80, l2: float = 1e-3) -> QualityField:
    """Maximum conditional likelihood of the line labels by Adam; see the module's text for the rounds."""
    flat = np.vstack(x)
    mean, spread = flat.mean(axis=0), flat.std(axis=0) + 1e-6
    std = [np.hstack([(a - mean) / spread, np.ones((len(a), 1))]) for a in x]
    lines = [np.full(len(a), int(label)) for a, label in zip(x, y, strict=True)]
    ends = np.cumsum([len(a) for a in x])[:-1]
    joined, n = np.vstack(std), len(flat)
    f = QualityField(mean, spread, np.zeros(joined.shape[1]), np.zeros((2, 2)), np.zeros(3))
    for _ in range(rounds):
        f.weights, f.trans = np.zeros(joined.shape[1]), np.zeros((2, 2))
        gold = np.concatenate(lines)
        seen = np.zeros((2, 2))
        for labels in lines:
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
        m = [np.zeros_like(f.weights), np.zeros((2, 2))]
        v = [np.zeros_like(f.weights), np.zeros((2, 2))]
        for step in range(1, steps + 1):
            z = joined @ f.weights
            post, pairs, _ = packed_marginals(np.split(np.column_stack([-z / 2, z / 2]), ends), f.trans)
            good = np.concatenate([p[:, 1] for p in post])
            grads = (joined.T @ (good - gold) / n + l2 * f.weights, (pairs - seen) / n + l2 * f.trans)
            for k, (p, g) in enumerate(zip((f.weights, f.trans), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                p -= 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        z = joined @ f.weights
        post, _, _ = packed_marginals(np.split(np.column_stack([-z / 2, z / 2]), ends), f.trans)
        for i, p in enumerate(post):
            if y[i] == 0:
                lines[i] = (p[:, 1] > 0.5).astype(int)
                lines[i][int(np.argmin(p[:, 1]))] = 0
    d = np.array([[*_shares(p[:, 1], s), 1.0] for p, s in zip(post, sizes, strict=True)])
    for _ in range(60):  # Newton's method on three weights
        q = 1 / (1 + np.exp(-np.clip(d @ f.curve, -30, 30)))
        h = (d * (q * (1 - q))[:, None]).T @ d + 1e-2 * np.eye(3)
        f.curve = f.curve - np.clip(np.linalg.solve(h, d.T @ (q - y) + 1e-2 * f.curve), -2, 2)
    return f


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, keep: Column | None = None) -> QualityField:
    """Fit on at most ``max_rows`` labelled documents, half of them bad where there are so many; the bound is on the driver's memory.

    The rows are those with the smallest hashes of their ids in each class. Only line
    features reach the driver. Without rows of both classes the field answers 0.5.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.where(keep) if keep is not None else y
    half = max_rows // 2
    picked = [y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for k in (0, 1)]
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # bound: max_rows rows of 12 bytes
    kind = dict(sample.dtypes)["doc_id"]

    def start():
        def one(r):
            x, sizes = document_features(r["text"])
            yield r["doc_id"], r["y"], x.astype(np.float32)[:, :N_OWN].tobytes(), sizes.astype(np.float32).tobytes()

        return one

    rows = sorted(map_rows(sample, f"doc_id {kind}, y int, x binary, sizes binary", start).collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    y01 = np.array([float(r["y"] > 0) for r in rows])
    if not rows or y01.min() == y01.max():
        return QualityField(np.zeros(3 * N_OWN), np.ones(3 * N_OWN), np.zeros(3 * N_OWN + 1), np.zeros((2, 2)), np.zeros(3))
    xs, sizes = [], []
    for r in rows:
        own = np.frombuffer(r["x"], np.float32).reshape(-1, N_OWN).astype(float)
        pad = np.zeros((1, N_OWN))
        xs.append(np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad])]))
        sizes.append(np.frombuffer(r["sizes"], np.float32).astype(float))
    return fit_field(xs, sizes, y01)


def score_quality(docs: DataFrame, field: QualityField, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, good_share, n_lines.

    Reads nothing but the text for the score. A null text is the empty text, which is one
    empty line; repeated rows give repeated results; a null id counts as held in fold 0.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def start():
        def one(r):
            score, share = field.score(r["text"])
            yield r["doc_id"], score, share, r["text"].count("\n") + 1

        return one

    scored = map_rows(rows, f"doc_id {kind}, score double, good_share double, n_lines bigint", start)
    return scored.select(
        "doc_id", (bucket_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share", "n_lines"
    )
