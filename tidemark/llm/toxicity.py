"""Toxicity by weak supervision.

Lexicon voters are terms (words, and beginnings of words of three to seven letters) met mostly in texts labelled
toxic, pattern voters look at the form of a text.  A generative model of two hidden classes estimates, without
labels, how often each voter speaks up in either class (its accuracy), and from what is left within the classes how far voters
repeat each other (their correlations); a voter's evidence is divided by the number of voters it repeats.
The model's posterior labels train a linear classifier over the voters and more terms, which scores every text.

Terms are mined and both models fitted on a bounded sample: at most ``per_class`` labelled rows of each class.
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

from tidemark.llm.common import Cache, text_of
from tidemark.llm.labelled import fit_logistic, remainder, sample_ids, sampled_texts, sigmoid

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6, 7)
#: Digits and signs written for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
_BLANKS = str.maketrans("\t\n\r\x0b\x0c", "     ")
PATTERNS = ("shouting", "exclaiming", "disguised", "accusing")


def terms_of(run: str) -> tuple[str, ...]:
    """Terms of a run without blanks: its words and their beginnings, as written and with look-alikes undone."""
    found = dict.fromkeys(_WORD.findall(run.lower()))
    if any(c.isdigit() or c in "@$!" for c in run[1:-1]):
        found.update(dict.fromkeys(_WORD.findall(run.lower().translate(LOOKALIKES))))
    out: dict[str, None] = {}
    for w in found:
        out[w] = None
        out.update((w[:k] + "*", None) for k in _PREFIXES if len(w) >= k)
    return tuple(out)


def runs_of(text: str) -> set[str]:
    return set(text.translate(_BLANKS).split(" "))


def patterns_of(text: str, runs: set[str], known: set[str]) -> tuple[int, ...]:
    """Numbers of the pattern voters that speak up."""
    upper = sum(1 for r in runs if len(r) > 2 and r.isupper())
    disguised = any(r[1:-1] and any(c.isdigit() or c in "@$!" for c in r[1:-1]) and any(w in known for w in _WORD.findall(r.lower().translate(LOOKALIKES))) for r in runs)
    return tuple(i for i, on in enumerate((2 * upper > len(runs), 100 * text.count("!") > len(text), disguised, "you" in runs and "are" in runs)) if on)


def mined(rows: DataFrame, n_terms: int, least: int, rate: float, precision: float = 0.8) -> list[str]:
    """Terms that name class 1 with the given precision, judged from ``rows`` (bounded sample: ``label``, ``text``).

    ``rate`` is the share of class 1 outside the sample.  The terms met in most texts come first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                counts[label].update({t for r in runs_of(text) for t in terms_of(r)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"term": pd.Series(terms, dtype=object), "n0": [counts[0][t] for t in terms], "n1": [counts[1][t] for t in terms]})

    # a term must be in one of 150 texts of its class, or chance alone would bring some
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0) + 1, sizes.get(1, 0) + 1
    found = rows.select("label", "text").mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lift = F.log((F.col("n1") / n1) / ((F.col("n0") + 0.5) / n0))
    best = found.where((F.col("n1") >= max(least, n1 // 150)) & (lift > np.log(precision / (1 - precision) * (1 - rate) / rate))).withColumn("gain", F.col("n1") * lift)
    return [r["term"] for r in best.orderBy(F.desc("gain"), "term").limit(n_terms).collect()]


@dataclass
class LabelModel:
    """Two hidden classes; voter j speaks up with probability ``on[c, j]`` in class c, no lexicon voter does with ``silent[c]``.

    A voter that does not speak up abstains; ``share[j]`` divides its evidence among the voters it repeats
    (those with a correlation over one half within the classes).
    """

    prior: float
    on: np.ndarray
    silent: np.ndarray
    share: np.ndarray
    lexicon: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        spoken = votes @ (self.share * np.log(self.on[1] / self.on[0]))
        evidence = spoken + np.where(votes[:, self.lexicon].any(axis=1), 0, np.log(self.silent[1] / self.silent[0]))
        return sigmoid(evidence + np.log(self.prior / (1 - self.prior)))

    def accuracy(self) -> np.ndarray:
        """Share of each voter's votes that are right, by the model."""
        right = self.prior * self.on[1]
        return right / (right + (1 - self.prior) * self.on[0])


def fit_label_model(votes: np.ndarray, prior: float, precision: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation from the start that a text with a precise vote is class 1; labels are not used.

    ``precision[j]`` is the least share of voter j's votes taken to be right: without it the two classes could
    come to be two kinds of toxic text.
    """
    n, m = votes.shape
    lexicon = precision > 0.5
    mute = ~votes[:, lexicon].any(axis=1)
    q = np.where(mute, 0.1, 0.9)
    most = (1 - precision) * (votes.mean(axis=0) + 0.5 / n) / (1 - prior)
    for _ in range(rounds):
        classes = np.stack([1 - q, q])
        total = classes.sum(axis=1) + 1
        on = (classes @ votes + np.array([[0.1], [0.5]])) / total[:, None]
        on[0] = np.minimum(on[0], most)
        left = votes - classes.T @ on
        size = np.sqrt((left * left).sum(axis=0)) + 1e-9
        alike = (left.T @ left) / np.outer(size, size)
        alike = np.where(alike > 0.5, np.minimum(alike, 1), 0) + 1e-9
        model = LabelModel(prior, np.clip(on, 1e-4, 1 - 1e-4), (classes @ mute + 0.5) / total, 1 / alike.sum(axis=0), lexicon)
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    label_model: LabelModel | None = None

    def known(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}


class Voices:
    """Numbers of the terms and patterns found in a text; patterns come after the terms."""

    def __init__(self, terms: list[str]) -> None:
        self.index = {t: i for i, t in enumerate(terms)}
        self.words = {t for t in terms if not t.endswith("*")}
        self.cache = Cache(lambda run: tuple(self.index[t] for t in terms_of(run) if t in self.index))

    def of(self, text: str) -> list[int]:
        runs, found = runs_of(text), set()
        for run in runs:
            if hits := self.cache[run]:
                found.update(hits)
        return sorted(found) + [len(self.index) + i for i in patterns_of(text, runs, self.words)]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = 3_000, n_terms: int = 600, n_voters: int = 200, least: int = 4) -> Model:
    """Fit on rows of ``labels`` for which ``allowed`` holds.  Without any toxic row no term is known and scores are the class's rate."""
    sizes = {r["label"]: r["n"] for r in labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    rate = (sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + sizes.get(1, 0) + 1)
    rows = sampled_texts(docs, sample_ids(labels, label, allowed, per_class)).select("doc_id", "label", "text")
    terms = mined(rows, n_terms, least, rate)
    width = len(terms) + len(PATTERNS)

    def voices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Voices(terms).of
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "hits": [of(t) for t in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(voices, f"doc_id {kind}, label int, hits array<int>").toPandas().sort_values("doc_id")
    x = np.zeros((len(found), width))
    for i, hits in enumerate(found["hits"]):
        x[i, np.asarray(hits, dtype=int)] = 1
    if not terms:
        return Model([], np.r_[np.log(rate / (1 - rate)), np.zeros(width)])
    here = float(np.clip(found["label"].mean(), 0.01, 0.99))
    # of terms that speak up in the very same texts, one is a voter
    alone = np.sort(np.unique(x[:, : len(terms)], axis=1, return_index=True)[1])[:n_voters]
    voters = np.r_[alone, np.arange(len(terms), width)]
    lexicon = x[:, voters]
    model = fit_label_model(lexicon, here, np.where(voters < len(terms), 0.95, 0.5))
    q = model.posterior(lexicon)
    # the sample's classes have other rates than the labelled rows
    weight = np.where(found["label"] == 1, rate / here, (1 - rate) / (1 - here))
    weights = fit_logistic(np.c_[np.ones(len(x)), x], q, weight, ridge=0.05)
    # the classifier says how texts rank, the sampled labels what chance of label 1 goes with a rank
    z = np.c_[np.ones(len(x)), x] @ weights
    shift, slope = fit_logistic(np.c_[np.ones(len(x)), z], found["label"].to_numpy(dtype=float), weight, ridge=0.01)
    weights = weights * slope
    weights[0] += shift
    return Model(terms, weights, model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; nulls are empty texts and get a score as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, w = Voices(model.terms).of, model.weights[1:].tolist()
        for batch in batches:
            z = [sum(w[i] for i in of(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(np.array(z, dtype=float) + model.weights[0])})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, threshold: float = 0.7, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, learnt from labels whose remainder is not ``held_out``."""
    model = fit(docs, labels, remainder(divisor) != held_out, **bounds)
    out = score(docs, model)
    return out.select("doc_id", (remainder(divisor) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
