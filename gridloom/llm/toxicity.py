"""Toxicity by a classifier chain.

Categories are predicted in order; the model of each sees hashed words of the text and the probabilities of the
categories before it. While fitting, those probabilities are out of fold: a document's come from models that
did not see it, so later models learn how far earlier ones can be trusted.

Only a bounded sample of labelled documents is used for fitting: of the toxic and of the other ones the ``FIT_ROWS`` / 2
that come first by hash of the id, so that words of rare languages are met in as many toxic documents as the bound allows.
Features are made on the executors from whole texts, and what reaches the driver is that sample's word hashes.

Columns are scaled by their standard deviation before the penalty chooses words, so a word of a rare language has the same
chance as a common one, and both classes weigh the same. The penalty is a multiple of what chance alone reaches,
sqrt(2 ln(words) / examples) standard errors; the multiple is chosen on held-out examples.

Edge cases: a null or empty text has no words and gets the models' base rates; null labels are left out of fitting;
several labels of a document are examples each; a category without both kinds of examples has a constant
probability; without labels everything is 0; a null id and repeated rows are scored as they come; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FIT_ROWS = 16_000
BUCKETS = 1 << 20
#: Hashed words that a model weighs, chosen by log-odds on the sample.
SELECTED = 512
FOLDS = 4
#: Multiples of the penalty that chance alone reaches, among which held-out examples choose.
PENALTIES = (0.25, 0.5, 1.0)
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def categories() -> dict[str, Column]:
    """The chain, in order: toxic at all, toxic in otherwise good prose, toxic in junk."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic": toxic, "toxic_prose": toxic & good, "toxic_junk": toxic & ~good}


class _Buckets(dict):
    """Words to buckets, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = k = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return k


_buckets = _Buckets()


def word_buckets(text: str | None) -> set[int]:
    return {_buckets[w] for w in set(_WORD.findall((text or "").lower()))}


@dataclass
class Link:
    """One category's model: bucket weights, weights of earlier categories' log-odds, intercept."""

    weights: dict[int, float]
    earlier: np.ndarray
    bias: float
    multiple: float | None = None

    def logit(self, buckets: set[int], before: list[float]) -> float:
        held = self.weights.keys() & buckets
        return self.bias + sum(self.weights[b] for b in held) + float(np.dot(self.earlier, before))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose presence differs most between the classes, in standard errors of the log-odds."""
    n1, n0 = y.sum(), (~y).sum()
    c1 = np.bincount(np.concatenate([d for d, v in zip(docs, y) if v] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    c0 = np.bincount(np.concatenate([d for d, v in zip(docs, y) if not v] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    seen = np.flatnonzero(c1 + c0 >= 3)
    a, b = c1[seen] + 0.5, c0[seen] + 0.5
    z = np.abs(np.log(a / (n1 - c1[seen] + 0.5)) - np.log(b / (n0 - c0[seen] + 0.5))) / np.sqrt(1 / a + 1 / b)
    return seen[np.argsort(-z, kind="stable")[:SELECTED]]


@dataclass
class Examples:
    """Which of the chosen words each example holds, as pairs (row, column), and a few dense columns, the last of ones."""

    rows: np.ndarray
    columns: np.ndarray
    words: int
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[: self.words][self.columns], len(self)) + self.dense @ w[self.words :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, g[self.rows], self.words), g @ self.dense])

    def of(self, chosen: np.ndarray) -> Examples:
        place = np.cumsum(chosen) - 1
        held = chosen[self.rows]
        return Examples(place[self.rows[held]], self.columns[held], self.words, self.dense[chosen])

    def only(self, columns: np.ndarray) -> Examples:
        """The words at ``columns``, and all dense columns."""
        place = np.full(self.words, -1)
        place[columns] = np.arange(len(columns))
        held = place[self.columns] >= 0
        return Examples(self.rows[held], place[self.columns[held]], len(columns), self.dense)

    def deviation(self) -> np.ndarray:
        share = np.bincount(self.columns, minlength=self.words) / len(self)
        return np.concatenate([np.sqrt(share * (1 - share)), self.dense[:, :-1].std(0), [1.0]]) + 1e-6


def _sparse_fit(x: Examples, y: np.ndarray, weight: np.ndarray, scale: np.ndarray, lasso: float, steps: int) -> np.ndarray:
    """Weighted logistic regression on columns divided by ``scale``, with an L1 penalty on all but the last, by accelerated
    proximal steps. The weights are those of the columns as they are."""
    v = np.ones(len(scale))
    for _ in range(30):  # the largest curvature, by power iteration
        v = x.back(weight * x.dot(v / scale)) / scale / len(x)
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    rate = 4.0 / max(1e-9, 1.05 * norm)
    w = v = np.zeros(len(scale))
    for n in range(steps):
        new = v - rate * x.back((_sigmoid(x.dot(v / scale)) - y) * weight) / scale / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lasso, 0)
        v, w = new + n / (n + 3) * (new - w), new
    return w / scale


def _two_fits(x: Examples, y: np.ndarray, multiple: float, steps: int) -> np.ndarray:
    """A first fit under a strong penalty on scaled columns picks words; a second, nearly free of penalty, gives them weights."""
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    scale = x.deviation()
    lasso = multiple * math.sqrt(0.25 * 2 * math.log(len(scale) + 1) / len(x))
    used = np.flatnonzero(_sparse_fit(x, y, weight, scale, lasso, steps)[: x.words])
    few = x.only(used)
    own = _sparse_fit(few, y, weight, np.ones(len(used) + x.dense.shape[1]), 1e-4, 3 * steps)
    w = np.zeros(len(scale))
    w[used], w[x.words :] = own[: len(used)], own[len(used) :]
    return w


def _held_out_loss(x: Examples, y: np.ndarray, multiple: float, steps: int) -> float:
    """Mean log loss of both classes on every fourth example, of a fit on the others."""
    held = np.arange(len(y)) % FOLDS == 0
    if any(len(np.unique(part)) < 2 for part in (y[held], y[~held])):
        return 0.0
    z = x.of(held).dot(_two_fits(x.of(~held), y[~held], multiple, steps))
    loss = np.logaddexp(0, np.where(y[held] > 0, -z, z))
    return float(loss[y[held] > 0].mean() + loss[y[held] <= 0].mean())


def fit_link(docs: list[np.ndarray], y: np.ndarray, before: np.ndarray, multiple: float | None = None, steps: int = 200) -> Link:
    """One category's model. Without ``multiple`` held-out examples choose it; the link remembers which."""
    y = y.astype(float)
    k = before.shape[1]
    if not y.any() or y.all():
        return Link({}, np.zeros(k), -12.0 if not y.any() else 12.0)
    chosen = select(docs, y > 0)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    found = [(at := place[d])[at >= 0] for d in docs]
    rows = np.repeat(np.arange(len(docs)), [len(f) for f in found])
    x = Examples(rows, np.concatenate(found), len(chosen), np.hstack([before / 4, np.ones((len(docs), 1))]))
    if multiple is None:
        multiple = min(PENALTIES, key=lambda m: _held_out_loss(x, y, m, steps))
    w = _two_fits(x, y, multiple, steps)
    keep = {int(b): float(t) for b, t in zip(chosen, w) if t}
    return Link(keep, w[len(chosen) : -1] / 4, float(w[-1]), multiple)


def without_copies(docs: list[np.ndarray], labels: np.ndarray, alike: float = 0.7) -> list[int]:
    """Numbers of the examples that stay. One goes if an earlier one has the same labels, the same two least words by two
    orders and at least ``alike`` of all words in common: near copies would put one document's words in several folds, and
    count them as many documents'."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for i, d in enumerate(docs):
        mixed = d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), (d.astype(np.uint64) + np.uint64(77)) * np.uint64(0xC2B2AE3D27D4EB4F)
        near = seen.setdefault((*(int(m.min()) if len(m) else -1 for m in mixed), labels[i].tobytes()), [])
        shared = (len(np.intersect1d(d, docs[j], assume_unique=True)) for j in near)
        if not any(both >= alike * (len(d) + len(docs[j]) - both) for j, both in zip(near, shared)):
            near.append(i)
            out.append(i)
    return out


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """``labels``: a column for each category. Earlier log-odds are out of fold."""
    stay = without_copies(docs, labels)
    docs, labels = [docs[i] for i in stay], labels[stay]
    fold = np.arange(len(docs)) % folds
    before = np.zeros((len(docs), 0))
    chain = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(bool)
        chain.append(fit_link(docs, y, before))
        multiple = chain[-1].multiple or PENALTIES[0]
        if c + 1 < labels.shape[1]:
            held = np.zeros(len(docs))
            for f in range(folds):
                learn = np.flatnonzero(fold != f)
                link = fit_link([docs[i] for i in learn], y[learn], before[learn], multiple)
                weights = np.zeros(BUCKETS)
                weights[list(link.weights)] = list(link.weights.values())
                for i in np.flatnonzero(fold == f):
                    held[i] = np.clip(link.bias + weights[docs[i]].sum() + before[i] @ link.earlier, -8, 8)
            before = np.hstack([before, held[:, None]])
    return chain


def predict(chain: list[Link], buckets: set[int]) -> list[float]:
    before: list[float] = []
    for link in chain:
        before.append(float(np.clip(link.logit(buckets, before), -8, 8)))
    return [float(_sigmoid(z)) for z in before]


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"u": batch["__u"], "y": batch["y"], "at": [np.fromiter(sorted(word_buckets(t)), dtype=np.int32).tobytes() for t in batch["text"]]})


def _scores(chain: list[Link], names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.array([predict(chain, word_buckets(t)) for t in batch["text"]]).reshape(-1, len(names))
            yield pd.DataFrame({"id": batch["id"]} | {n: p[:, k] for k, n in enumerate(names)})

    return run


def learn_chain(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, chain: dict[str, Column], fit_rows: int) -> list[Link] | None:
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    y = F.array(*[c.cast("int") for c in chain.values()])
    known = known.select(F.col(id_col).alias("__id"), y.alias("y"), F.xxhash64(id_col, F.lit("fit")).alias("__u"))
    half = -(-fit_rows // 2)
    first = lambda df: df.orderBy("__u", "__id").limit(half)  # noqa: E731  top rows of each task, then of all: bounded
    sample = cut(first(known.filter(F.col("y")[0] == 1)).unionByName(first(known.filter(F.col("y")[0] == 0))))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "__id").select("__u", "y", "text")
    made = joined.mapInPandas(_examples, "u long, y array<int>, at binary")
    rows = made.orderBy("u").limit(2 * fit_rows).collect()  # bounded also where ids are repeated
    if not rows:
        return None
    at = [np.frombuffer(r["at"], dtype=np.int32).astype(np.int64) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (len(at[i]), bytes(rows[i]["at"]), rows[i]["y"]))  # whatever order they came in
    return fit_chain([at[i] for i in order], np.array([rows[i]["y"] for i in order]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id_col``, p_<category> of each category of the chain, toxic (p_toxic at least ``threshold``)."""
    names = list(categories())
    chain = learn_chain(docs, labels, id_col, text_col, categories(), fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if chain is None:
        scored = rows.select("id", *[F.lit(0.0).alias(n) for n in names])
    else:
        kind = docs.schema[id_col].dataType.simpleString()
        scored = rows.mapInPandas(_scores(chain, names), f"id {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.select(F.col("id").alias(id_col), *[F.col(n).alias(f"p_{n}") for n in names], (F.col("toxic") >= threshold).alias("toxic"))
