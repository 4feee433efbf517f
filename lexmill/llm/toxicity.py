"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are the words of fixed lexicons in four languages, shape patterns, and patterns (words and word
beginnings) that stand out in the labelled training rows. Labels do no more than propose those patterns,
refute voters that are mostly wrong and give the share of class 1: the label model never sees a row's label.
It is a latent-class model that estimates by EM how often each voter fires in either class, and from what
the classes leave unexplained how strongly voters depend on each other; the voters that fire on a row count as
the number of independent ones that their correlations make them, so agreeing copies count about once. A
logistic classifier over words and word beginnings is trained on the posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")

# Insults that the lexicon voters look for, in English, French, German and Spanish.
LEXICON = (
    "bastard clown creep disgusting dumb garbage hate idiot idiots imbecile jerk kill loser losers lunatic "
    "moron morons pathetic pig retard scum shut stupid trash ugly useless vermin vile worthless wretch "
    "abruti connard conne connasse crétin débile enculé imbécile merde nul ordure pourri salaud salope stupide "
    "abschaum arschloch blöd depp dumm dummkopf hässlich idioten mistkerl penner schwachkopf trottel vollidiot wertlos widerlich "
    "asco basura bastardo cabrón escoria estúpido gilipollas idiota imbécil inútil maldito mierda pendejo tonto"
).split()


@dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows that a model is fitted on at most, chosen by hash.
    max_fit_rows: int = 8000
    min_support: int = 4
    #: Standard errors that a mark's log-odds must exceed to be a pattern voter (by label) or a feature (by posterior).
    voter_z: float = 3.0
    feature_z: float = 3.5
    #: Share of a mark's documents that must be of class 1 for it to be a voter or a feature.
    voter_share: float = 0.95
    feature_share: float = 0.4
    #: Within-class correlation from which two voters are taken to depend on each other.
    least_correlation: float = 0.1
    #: Without the label model every fired voter counts alike (for comparison).
    generative: bool = True
    seed: int = 7


def marks(text: str | None) -> set[str]:
    """Distinct lower-case words (``=word``) and beginnings of 3 to 6 letters (``^begin``)."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) <= 40:
            out.add("=" + w)
        for k in (3, 4, 5, 6):
            if len(w) > k:
                out.add("^" + w[:k])
    return out


def shapes(text: str | None) -> list[str]:
    """Shape patterns: shouting and runs of exclamation marks."""
    t = text or ""
    n = max(1, len(t))
    return [name for name, on in (("!shout", sum(map(str.isupper, t)) > 0.5 * n), ("!bang", t.count("!!") > 0.01 * n)) if on]


def label_model(row: np.ndarray, voter: np.ndarray, n: int, m: int, balance: float, least: float = 0.1, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over voters that fire or abstain; (posterior of class 1, fire rates by class and voter, correlations).

    ``row`` and ``voter`` pair what fired where, among n rows and m voters; ``balance`` is the known share of class
    1. That one voter abstains says nothing of the class, as most know one language or one word only; that
    all do is an event with rates of its own.
    Two fits: the first takes voters as independent given the class; correlations are estimated on what it
    leaves over, and in the second a row's f fired voters count as the effective number of independent ones,
    ``f * f`` over the sum of the correlations among them.
    """
    fired = np.bincount(row, minlength=n)
    silent = np.flatnonzero(fired == 0)
    seen, event = np.concatenate([row, silent]), np.concatenate([voter, np.full(len(silent), m)])

    def posterior(evidence: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 whose mean is the share that class 1 is known to have."""
        lo, hi = -60.0, 60.0
        for _ in range(50):
            mid = (lo + hi) / 2
            q = 1 / (1 + np.exp(-np.clip(mid + evidence, -40, 40)))
            lo, hi = (mid, hi) if q.mean() < balance else (lo, mid)
        return q

    def em(q: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rates = np.zeros((2, m + 1))
        for _ in range(rounds):
            rates = np.stack([(np.bincount(event, w[seen], m + 1) + 0.5 * p) / (w.sum() + 1) for w, p in ((1 - q, 0.2), (q, 1.0))])
            gain = np.log(rates[1] / rates[0])
            new = posterior(worth * np.bincount(seen, gain[event], n))
            done, q = np.abs(new - q).max(initial=0) < 1e-5, new
            if done:
                break
        return q, rates[:, :m]

    q, rates = em(np.where(fired > 1, 0.9, np.where(fired > 0, 0.5, balance / 4)), np.ones(n))
    votes = np.zeros((n, m), np.float32)
    votes[row, voter] = 1
    left = votes - rates[1].astype(np.float32) * q[:, None].astype(np.float32) - rates[0].astype(np.float32) * (1 - q[:, None]).astype(np.float32)
    left /= np.sqrt((left**2).sum(0)) + 1e-9
    corr = left.T @ left
    corr[corr < least] = 0
    np.fill_diagonal(corr, 1)
    among = ((votes @ corr) * votes).sum(1)
    q, rates = em(q, np.where(fired > 0, fired / np.maximum(among, 1), 1.0))
    return q, rates, corr


def _stands_out(soft: np.ndarray, count: np.ndarray, n1: float, n: int) -> np.ndarray:
    """Log-odds of class 1 where a mark is against where it is not, in standard errors."""
    a, b = soft + 0.5, count - soft + 0.5
    c, d = n1 - soft + 0.5, (n - n1) - (count - soft) + 0.5
    return np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b)


def fit(texts: list[str], shape: list[str], labels: list[int], params: ToxicityParams) -> dict[str, float]:
    """Weights by mark; the bias under the empty string. Each text is its marks, one a line.

    Only marks of enough rows of class 1 are ever held, so memory follows those and not the vocabulary.
    """
    base = {"": -4.0, **{"=" + w: 8.0 for w in LEXICON}}
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return base  # nothing to learn from: the lexicon alone
    n, balance = len(y), y.mean()
    known = {"=" + w for w in LEXICON}
    pos: Counter[str] = Counter()
    for marks_, label in zip(texts, labels):
        if label and marks_:
            pos.update(marks_.split("\n"))
    names = sorted(known | {s for s, c in pos.items() if c >= params.min_support})
    at = {s: j for j, s in enumerate(names)}
    has = [np.fromiter((at[s] for s in t.split("\n") if s in at), int) for t in texts]
    row, mark = np.repeat(np.arange(n), [len(h) for h in has]), np.concatenate(has).astype(int)
    count = np.bincount(mark, minlength=len(names))
    by_label = np.bincount(mark, y[row], len(names))
    lexicon = np.array([s in known for s in names])
    # labels vet the voters: a lexicon word or shape that they refute votes no more, a pattern must stand out
    refuted = lexicon & (count - by_label > params.min_support) & (by_label < 0.5 * count)
    pattern = (_stands_out(by_label, count, y.sum(), n) >= params.voter_z) & (by_label >= params.voter_share * count) & (by_label >= params.min_support)
    voter = lexicon & (count > 0) & ~refuted | pattern
    number = np.cumsum(voter) - 1
    votes = voter[mark]
    shouts = [x for s in ("!shout", "!bang") if len(x := np.flatnonzero([s in t for t in shape])) and (y[x].mean() >= 0.5 or len(x) <= params.min_support)]
    m = int(voter.sum()) + len(shouts)
    v_row = np.concatenate([row[votes], *shouts]).astype(int)
    v_col = np.concatenate([number[mark[votes]], *(np.full(len(x), m - len(shouts) + k) for k, x in enumerate(shouts))]).astype(int)
    if params.generative:
        q, _, _ = label_model(v_row, v_col, n, m, balance, params.least_correlation)
    else:
        q = np.minimum(np.bincount(v_row, minlength=n) / 2, 1.0)
    soft = np.bincount(mark, q[row], len(names))
    feature = (_stands_out(soft, count, q.sum(), n) >= params.feature_z) & (soft >= params.feature_share * count) & (soft >= params.min_support - 1) & ~lexicon
    lexicon &= ~refuted
    # logistic regression on posterior labels; lexicon words share one weight, as each is rare
    width = int(feature.sum()) + 1
    column = np.where(feature, np.cumsum(feature) - 1, np.where(lexicon, width - 1, -1))
    own = np.unique(np.stack([row, column[mark]])[:, column[mark] >= 0], axis=1)
    w, b = np.zeros(width), float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3)))
    mw, vw, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(own[0], w[own[1]], n), -40, 40)))
        g = np.bincount(own[1], (p - q)[own[0]], width) / n + 2e-4 * w
        gb = float((p - q).mean())
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    out = {"": b} | {names[j]: float(w[column[j]]) for j in np.flatnonzero(feature) if abs(w[column[j]]) > 1e-3}
    return out | {names[j]: max(0.0, float(w[-1])) for j in np.flatnonzero(lexicon)}


def score_text(text: str | None, weights: dict[str, float]) -> float:
    """Probability of class 1; a text without words has the bias alone."""
    s = weights[""]
    get = weights.get
    seen = set()
    for w in set(WORD.findall((text or "").lower())):
        s += get("=" + w, 0.0)
        for k in (3, 4, 5, 6):
            if len(w) > k:
                seen.add(w[:k])
    for x in seen:
        s += get("^" + x, 0.0)
    return float(1 / (1 + np.exp(-min(40.0, max(-40.0, s)))))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_where: Column | None = None, params: ToxicityParams = ToxicityParams(),
) -> dict[str, float]:
    """Fit on at most ``params.max_fit_rows`` labelled rows, in one executor task of that bound.

    Labels with null ids or values are ignored, of repeated labels the greater counts. Without
    labels of both classes the lexicon alone decides. What comes back is one row of weights.
    """
    own = labels if train_where is None else labels.where(train_where)
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = (
        own.where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id", F.lit(params.seed)), "id").limit(params.max_fit_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "id": pdf["id"], "y": pdf["y"],
                "marks": ["\n".join(sorted(marks(t))) for t in pdf["text"]], "shapes": ["\n".join(shapes(t)) for t in pdf["text"]],
            })

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "marks"]).drop_duplicates("marks")  # a copied text is evidence once
        w = fit(pdf["marks"].tolist(), pdf["shapes"].tolist(), pdf["y"].tolist(), params)
        return pd.DataFrame({"k": list(w), "v": list(w.values())})

    # the sample's ids are at most max_fit_rows pairs of numbers: small enough to broadcast
    sample = texts.join(F.broadcast(picked), "id").mapInPandas(extract, "id long, y int, marks string, shapes string")
    # of rows that share an id one text is fitted on, so that repeated ids cannot pass the bound
    sample = sample.groupBy("id", "y").agg(F.min(F.struct("marks", "shapes")).alias("s")).select("id", "y", "s.*")
    got = sample.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: learn(pdf), "k string, v double").collect()
    return {r.k: r.v for r in got} or fit([], [], [], params)


def toxicity_scores(docs: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row: scores whole texts, map-only, no shuffle.

    Null and blank texts get the bias's score; null ids and repeated rows pass through. The broadcast
    weights are of the lexicon and of marks that enough of the bounded sample's rows hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            s = np.array([score_text(t, w) for t in pdf["text"]], float)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype("int32")})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, weights: dict[str, float], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns as they are; each row is judged by its own text, whatever its id. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for part in texts:
            yield pd.Series([score_text(t, w) < 0.5 for t in part], dtype=bool)

    return docs.where(F.pandas_udf(clean, "boolean")(F.col(text_col)))
