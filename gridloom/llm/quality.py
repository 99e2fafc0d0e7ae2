"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or abstain on every document (DataFrame expressions over the whole text).
2. Documents are counted by their pattern of votes: at most 3**labellers rows, whatever the data. On these counts of
   all documents expectation-maximisation estimates each labeller's accuracy and coverage and the share of good ones.
3. The posteriors of a bounded sample are the soft labels of a logistic regression on hashed features: byte pairs of the text
   and bands of its repetition and layout. The sample has at most ``FIT_ROWS`` / 2 documents that are more likely good and as
   many that are more likely bad (the smallest by hash of id and text), weighed by how many there are of either in all, so
   that junk is in it however rare it is.
4. The scorer rates every document; it stays if its score reaches ``threshold``.

Edge cases: a null or empty text and one of blanks alone (space and \\t to \\r) scores 0 and is rejected; a null id and repeated
rows are scored as they come, and equal texts get equal scores; an empty table gives an empty result; where no text is more
likely bad, or none more likely good, the score is the estimated share of good documents; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

FIT_ROWS = 4000
BUCKETS = 4096
THRESHOLD = 0.5


def measures(text: Column) -> dict[str, Column]:
    """What the labellers look at; taken in one projection so that each is computed once."""
    t = F.coalesce(text, F.lit(""))
    times = lambda x: (F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))) / len(x)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "m_words": F.greatest(count(r"[^\x20\x09-\x0D]+"), F.lit(1)),
        "m_length": F.greatest(F.char_length(t), F.lit(1)),
        "m_marks": count(r"[#$%&*@^~=+<>]{2,}"),
        "m_bars": times("|"),
        "m_shouts": times("!!"),
        "m_repeats": count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D](?=\1[\x20\x09-\x0D])"),
        "m_capitals": count(r"\p{Lu}{2,}+"),
        "m_odd": count(r"[^\p{L}\s.,;:?'-]"),
        "m_kinds": F.size(F.array_distinct(F.split(F.lower(t), r"[\x20\x09-\x0D]+"))),
    }


def labellers() -> dict[str, Column]:
    """1 good, 0 bad, null abstains, from the measures. Names are the votes' columns.

    The first four each know one fault and else abstain; the others see several faults, so that labellers overlap.
    """
    words, each = F.col("m_words"), F.col("m_length") / F.col("m_words")
    share = lambda name: F.col(name) / words
    fault = lambda bad: F.when(bad, F.lit(0))
    vote = lambda bad, good: F.when(bad, F.lit(0)).when(good, F.lit(1))
    enough, odd, kinds = words >= 8, F.col("m_odd") / F.col("m_length"), share("m_kinds")
    return {
        "marks": fault(share("m_marks") > 0.15),
        "bars": fault(share("m_bars") > 0.15),
        "shouts": fault(share("m_shouts") > 0.15),
        "repeats": fault(enough & (share("m_repeats") > 0.15)),
        "capitals": vote(enough & (share("m_capitals") > 0.25), enough & (share("m_capitals") < 0.05)),
        "odd": vote(odd > 0.06, odd < 0.03),
        "variety": vote(enough & (kinds < F.least(F.lit(0.3), 3 / F.sqrt(words))), enough & (kinds > 0.4)),
        "word_length": vote((each < 2.5) | (each > 14), enough & (each > 3.5) & (each < 11)),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], float]], rounds: int = 200, prior: float = 0.8) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (votes, count): the share of good ones, and each labeller's P(votes good | good) and P(votes bad | bad).

    Votes are independent given the class; an abstention says nothing. It starts from labellers that seldom call a
    good document bad but miss many bad ones, which also says which of the two classes is the good one.
    """
    m = len(patterns[0][0])
    votes = np.array([[np.nan if v is None else v for v in p] for p, _ in patterns], dtype=float).reshape(-1, m)
    count = np.array([c for _, c in patterns], dtype=float)
    cast, good_vote = ~np.isnan(votes), np.nan_to_num(votes) == 1
    sure_good, sure_bad, share = np.full(m, 0.97), np.full(m, 0.4), prior
    for _ in range(rounds):
        post = posterior(votes, share, sure_good, sure_bad)
        wg, wb = count * post, count * (1 - post)
        before = share
        share = float(np.clip((wg.sum() + 8) / (count.sum() + 10), 0.02, 0.98))
        sure_good = np.clip(((wg[:, None] * (cast & good_vote)).sum(0) + 19.4) / ((wg[:, None] * cast).sum(0) + 20), 0.55, 0.999)
        # A junk document need not show every fault, so only chance is the floor for a bad vote.
        sure_bad = np.clip(((wb[:, None] * (cast & ~good_vote)).sum(0) + 4) / ((wb[:, None] * cast).sum(0) + 10), 0.02, 0.999)
        if abs(share - before) < 1e-9:
            break
    return share, sure_good, sure_bad


def posterior(votes: np.ndarray, share: float, sure_good: np.ndarray, sure_bad: np.ndarray) -> np.ndarray:
    """P(good | votes); ``votes`` holds 1, 0 and nan."""
    good, bad = votes == 1, votes == 0
    lg = np.log(share) + good @ np.log(sure_good) + bad @ np.log(1 - sure_good)
    lb = np.log(1 - share) + good @ np.log(1 - sure_bad) + bad @ np.log(sure_bad)
    return 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))


def features(text: str) -> np.ndarray:
    """Hashed features: shares of byte pairs (one bucket by an odd multiplier), and bands of six measures."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.float32)
    if len(raw) > 1:
        pair = (raw[:-1] * 256 + raw[1:]) * np.uint32(2654435761) >> np.uint32(21)  # 2048 buckets
        out[:2048] = np.sqrt(np.bincount(pair, minlength=2048) / len(pair))
    words = text.split()
    n = max(1, len(words))
    same = sum(a == b for a, b in itertools.pairwise(words)) / n
    caps = sum(w.isupper() and len(w) > 1 for w in words) / n
    marks = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words) / n
    measures = (same, caps, marks, text.count("|") / n, text.count("!!") / n, len(set(words)) / n)
    for k, v in enumerate(measures):
        out[2048 + 64 * k + min(63, int(v * 32))] = 1.0
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the last one the intercept (Nesterov's gradient steps)."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(np.float32)
    weight = np.ones(len(x), dtype=np.float32) if weight is None else (weight / weight.mean()).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    rate = 4.0 / max(1e-9, float((weight * (x * x).sum(1)).mean()))
    for n in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = ((p - y) * weight) @ x / np.float32(len(x))
        g[:-1] += ridge * v[:-1] / 10
        new = v - np.float32(rate) * g
        v = (new + np.float32(n / (n + 3)) * (new - w)).astype(np.float32)
        w = new
    return w


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [features(t) for t in batch["text"]]
        at = [np.flatnonzero(r) for r in rows]
        yield pd.DataFrame({"u": batch["__u"], "post": batch["post"], "at": at, "value": [r[k] for r, k in zip(rows, at)]})


def _score(weights: np.ndarray, fallback: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = [float(features(t) @ weights[:-1] + weights[-1]) if t and t.strip(" \t\n\v\f\r") else None for t in batch["text"]]
            score = [0.0 if v is None else 1 / (1 + np.exp(-np.clip(v, -500, 500))) for v in z]
            if not np.any(weights):
                score = [0.0 if v is None else fallback for v in z]
            yield pd.DataFrame({"id": batch["id"], "score": score})

    return run


def learn_scorer(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float] | None:
    """(weights of the scorer, estimated share of good documents) of ``rows`` (id, text); None without any text of words. The
    weights are all 0 where nothing tells good documents from bad ones."""
    unit = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text"), F.lit("fit"))
    names = list(labellers())
    measured = rows.filter(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    measured = measured.select(unit.alias("__u"), *[m.alias(n) for n, m in measures(F.col("text")).items()])
    voted = cut(measured.select("__u", *[v.alias(n) for n, v in labellers().items()]))
    patterns = [(tuple(r[:-1]), float(r[-1])) for r in voted.groupBy(*names).count().collect()]  # <= 3**labellers
    if not patterns:
        return None
    share, sure_good, sure_bad = estimate(patterns)
    grid = np.array([[np.nan if v is None else v for v in p] for p, _ in patterns], dtype=float)
    post, count = posterior(grid, share, sure_good, sure_bad), np.array([c for _, c in patterns])
    table = rows.sparkSession.createDataFrame([(*p, float(v)) for (p, _), v in zip(patterns, post)], ", ".join(f"{n} int" for n in names) + ", post double")
    rated = voted.join(F.broadcast(table), [voted[n].eqNullSafe(table[n]) for n in names]).select("__u", "post")
    half = -(-fit_rows // 2)
    first = lambda df: df.orderBy("__u").limit(half)  # noqa: E731  top rows of each task, then of all: bounded
    chosen = cut(first(rated.filter("post >= 0.5")).unionByName(first(rated.filter("post < 0.5"))).dropDuplicates(["__u"]))
    picked = rows.withColumn("__u", unit).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "__u").select("__u", "text", "post")
    made = picked.select("__u", "post", "text").mapInPandas(_featurise, "u long, post double, at array<int>, value array<float>")
    learn = made.orderBy("u").limit(2 * fit_rows).collect()  # bounded also where rows are repeated
    x = np.zeros((len(learn), BUCKETS), dtype=np.float32)
    for k, r in enumerate(learn):
        x[k, r["at"]] = r["value"]
    y = np.array([r["post"] for r in learn])
    weights, good = np.zeros(BUCKETS + 1), y >= 0.5
    if good.any() and not good.all():
        weights = fit(x, y, np.where(good, count[post >= 0.5].sum() / good.sum(), count[post < 0.5].sum() / (~good).sum()))
    return weights, share


def weak_label_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each document: ``id_col``, score (0 to 1), keep. ``fit_rows`` bounds the documents that the scorer
    is fitted on; the labellers' accuracies come from all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    learnt = learn_scorer(rows, fit_rows)
    if learnt is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    weights, share = learnt
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInPandas(_score(weights, share), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, all columns. A row is matched to its verdict by a hash of id and text, so it neither keeps nor
    takes along another text of its id."""
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, row_key(F.col(id_col), F.col(text_col).cast("string")))
    verdict = weak_label_quality(keyed, name, text_col, **options)
    good = verdict.filter("keep").select(name).distinct()
    return keyed.join(good, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
