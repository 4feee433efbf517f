"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; the unlabelled side is web text as it comes. The
class prior is estimated from how thin the unlabelled side gets, against the positives, where a
first classifier scores highest. A small network is then trained on the non-negative risk. What it sees
of a text are hashed words and character pairs, whose first layer is learned, and a few plain counts; no
threshold or list of signs of bad text is given to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed character pairs and of hashed words, and plain counts.
PAIRS, WORDS, COUNTS = 128, 128, 10
WIDTH = COUNTS + PAIRS + WORDS


@dataclass(frozen=True)
class QualityParams:
    #: Rows of either side that a model is fitted on at most, chosen by hash.
    max_positive: int = 8000
    max_unlabelled: int = 16000
    hidden: int = 12
    epochs: int = 200
    decay: float = 1e-3
    #: Hashed shares are divided by this one number, so that rare buckets are not blown up to unit variance.
    spread: float = 0.3
    seed: int = 11


class _Buckets(dict):
    """Bucket of each lower-case word; emptied when it gets large, so a worker's memory stays bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % WORDS
        return v


_WORD = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Counts over the words and characters of a whole text, then the roots of the shares of hashed
    character pairs and words; all zero but for the first number for a text without words."""
    out = np.zeros(WIDTH, np.float32)
    t = text or ""
    w = t.split()
    n = len(w)
    if not n:
        out[0] = 1
        return out
    lines = [x for x in t.split("\n") if x]
    step = [len(set(w[i : i + 100])) / len(w[i : i + 100]) for i in range(0, n, 100)]
    out[1:COUNTS] = (
        sum(a == b for a, b in zip(w, w[1:])) / n, sum(map(str.isdigit, t)) / len(t), sum(map(str.isalpha, t)) / len(t), sum(map(str.isupper, t)) / len(t),
        1 - len(set(lines)) / max(1, len(lines)), sum(step) / len(step), min(step), min(sum(map(len, w)) / n / 20, 2.0), min(np.log1p(n) / 10, 2.0))
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = (((c[:-1] << np.uint64(32)) | c[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    out[COUNTS : COUNTS + PAIRS] = np.sqrt(np.bincount(pair.astype(np.int64), minlength=PAIRS) / len(t))
    own = np.fromiter(map(_WORD.__getitem__, t.lower().split()), np.int64)
    out[COUNTS + PAIRS :] = np.sqrt(np.bincount(own, minlength=WORDS) / n)
    return out


def class_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Least ratio of the two sides' upper tails of scores, over tails with enough positives."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.7, 27))
    slack = 0.5 / np.sqrt(max(1, len(positive)))
    ratios = [(np.mean(unlabelled >= c) + slack / 4) / max(np.mean(positive >= c) - slack / 4, 1e-3) for c in cuts]
    return float(np.clip(min(ratios), 0.02, 0.98))


def _forward(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ m["w1"] + m["b1"])
    return h, h @ m["w2"] + m["b2"]


def _train(loss_grad, x: np.ndarray, params: QualityParams) -> dict[str, np.ndarray]:
    rng, f = np.random.default_rng(params.seed), np.float32
    m = {"w1": rng.normal(0, 0.1, (x.shape[1], params.hidden)), "b1": np.zeros(params.hidden), "w2": rng.normal(0, 0.4, params.hidden), "b2": np.zeros(())}
    m = {k: p.astype(f) for k, p in m.items()}
    a, v = ({k: np.zeros_like(p) for k, p in m.items()} for _ in range(2))
    for t in range(1, params.epochs + 1):
        h, out = _forward(m, x)
        d = loss_grad(out).astype(f)
        dh = np.outer(d, m["w2"]) * (1 - h * h)
        grads = {"w2": h.T @ d, "b2": d.sum(), "w1": x.T @ dh, "b1": dh.sum(0)}
        for k, g in grads.items():
            g = g + params.decay * m[k]
            a[k], v[k] = 0.9 * a[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            m[k] = (m[k] - 0.03 * (a[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(f)
    return m


def fit(positive: np.ndarray, unlabelled: np.ndarray, params: QualityParams) -> dict[str, np.ndarray]:
    """Network on centred and scaled features; without rows of both sides every score is one half."""
    if not len(positive) or not len(unlabelled):
        d = WIDTH
        return {"mean": np.zeros(d), "std": np.ones(d), "w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros(1), "b2": np.zeros(()), "prior": np.array(0.5)}
    both = np.concatenate([positive, unlabelled])
    mean, std = both.mean(0), both.std(0) + 1e-3
    std[COUNTS:] = params.spread
    x, n = ((both - mean) / std).astype(np.float32), len(positive)
    u = len(unlabelled)
    side = np.arange(len(x)) < n
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    # a first classifier of the two sides, for the prior, judged on rows it was not trained on
    fold = np.random.default_rng(params.seed).random(len(x)) < 0.5
    weight = np.where(side, 0.5 / n, 0.5 / u) * fold * 2
    first = _train(lambda z: weight * (sig(z) - side), x, params)
    s = _forward(first, x)[1]
    held = ~fold if (~fold & side).any() and (~fold & ~side).any() else fold
    prior = class_prior(s[held & ~side], s[held & side])

    def risk(z: np.ndarray) -> np.ndarray:
        p = sig(z)
        slope = p * (1 - p)  # of the sigmoid loss
        as_negative = p[~side].mean() - prior * p[side].mean()
        d = np.zeros_like(z)
        if as_negative >= 0:
            d[side] = (-prior * slope[side] - prior * slope[side]) / n
            d[~side] = slope[~side] / u
        else:  # the negative part may not fall below zero: step back up
            d[side] = prior * slope[side] / n
            d[~side] = -slope[~side] / u
        return d

    return _train(risk, x, params) | {"mean": mean, "std": std, "prior": np.array(prior)}


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = _forward(model, (x - model["mean"]) / model["std"])[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_where: Column | None = None, params: QualityParams = QualityParams(),
) -> dict[str, np.ndarray]:
    """Fit on bounded samples of features (a kilobyte a row), which alone reach the driver.

    Only labels of 1 are used; null and repeated labels are harmless. The unlabelled side is drawn
    from all documents, whatever their label.
    """
    own = labels if train_where is None else labels.where(train_where)
    trusted = (
        own.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
        .orderBy(F.xxhash64("id", F.lit(params.seed)), "id").limit(params.max_positive)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    web = texts.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(params.seed + 1)), "id").limit(params.max_unlabelled)
    sides = trusted.select("id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(web.select("id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    sides = sides.groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "p": pdf["p"], "u": pdf["u"], "x": [features(t).tobytes() for t in pdf["text"]]})

    # of rows that share an id one text is fitted on, so that repeated ids cannot pass the bound
    got = texts.join(F.broadcast(sides), "id").mapInPandas(run, "id long, p int, u int, x binary")
    got = got.groupBy("id", "p", "u").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    rows = lambda k: np.frombuffer(b"".join(got.loc[got[k] == 1, "x"]), np.float32).reshape(-1, WIDTH)
    return fit(rows("p"), rows("u"), params)


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row: scores whole texts, map-only, no shuffle.

    Null and blank texts are scored by the feature that marks them; null ids and repeated rows pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]], np.float32).reshape(-1, WIDTH)
            s = score(shared.value, x)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype("int32")})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
