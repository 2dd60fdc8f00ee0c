"""Quality scores by compression with dictionaries of good and of bad text.

Two Zstandard dictionaries are built from pieces of good and of bad labelled texts.  A text is compressed
in pieces with each; the difference of the sizes over their sum says which of the two it resembles, and the
sizes over the text's own length how much of it is repetition.  A logistic curve over these and their squares, fitted
on other labelled rows, turns them into a calibrated score.

Both are fitted on bounded samples of labelled rows: ``per_class`` rows of each class for the dictionaries and as many for the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.labelled import fit_logistic, remainder, sample_ids, sampled_texts, sigmoid

PIECE, LEVEL = 2048, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (expanded(features) - self.center) / self.scale
        return sigmoid(np.c_[np.ones(len(x)), x] @ self.weights)


def expanded(f: np.ndarray) -> np.ndarray:
    return np.c_[f, f * f, f[:, 0] * f[:, 1], f[:, 0] * f[:, 2]]


def dictionary(texts: list[bytes], size: int, per_text: int = 8, piece: int = 1024) -> bytes:
    """A dictionary from pieces spread evenly over each text; raw content where there is too little to train one."""
    import zstandard

    parts = []
    for text in texts:
        if len(text) <= per_text * piece:
            parts += [text[i : i + piece] for i in range(0, len(text), piece)]
        else:
            parts += [text[i : i + piece] for i in np.linspace(0, len(text) - piece, per_text).astype(int)]
    parts = [p for p in parts if len(p) >= 16]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


class Sizes:
    """Compressed-size features of a text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}

        def compressor(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, **{k: v for k, v in plain.items()})

        self.good, self.bad, self.own = compressor(good).compress, compressor(bad).compress, compressor(b"").compress

    def of(self, text: str) -> tuple[float, float, float]:
        data = text.encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]
        good = sum(len(self.good(p)) for p in pieces)
        bad = sum(len(self.bad(p)) for p in pieces)
        return (bad - good) / (bad + good), len(self.own(data)) / max(len(data), 1), good / max(len(data), 1)


def features(rows: DataFrame, good: bytes, bad: bytes, keep: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, typed by ``keep``, and ``f0, f1, f2``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad)
        for batch in batches:
            found = pd.DataFrame([sizes.of(t) for t in batch["text"]], columns=["f0", "f1", "f2"], index=batch.index)
            yield pd.concat([batch.drop(columns="text"), found], axis=1)

    return rows.mapInPandas(run, f"{keep}, f0 double, f1 double, f2 double")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = 2_000, dictionary_size: int = 65_536, piece_bytes: int = 8_192) -> Model:
    """Fit on rows of ``labels`` for which ``allowed`` holds; 1 is good.  Without rows of both classes every score is their rate, or one half."""
    half = F.xxhash64(F.lit("half"), F.col("doc_id")).bitwiseAND(1)
    counts = {r["label"]: r["n"] for r in labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    n = piece_bytes // 4

    # what is sent to the driver of a sampled text: the whole of it, or four even pieces of a long one
    def spread(t: Column) -> Column:
        size = F.char_length(t)
        at = lambda k: F.substring(t, (F.lit(1) + ((size - n) * k / 3)).cast("int"), F.lit(n))
        return F.when(size <= piece_bytes, t).otherwise(F.concat(*[at(k) for k in range(4)]))

    mine = sample_ids(labels, label, allowed & (half == 0), per_class)
    for r in sampled_texts(docs, mine).select("doc_id", "label", spread(F.col("text")).alias("text")).orderBy("doc_id").collect():
        texts[r["label"]].append(r["text"].encode())
    good, bad = dictionary(texts[1], dictionary_size), dictionary(texts[0], dictionary_size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    others = sampled_texts(docs, sample_ids(labels, label, allowed & (half == 1), per_class)).select("doc_id", "label", "text")
    table = features(others, good, bad, f"doc_id {kind}, label int").toPandas().sort_values("doc_id")
    f, y = table[["f0", "f1", "f2"]].to_numpy(dtype=float), table["label"].to_numpy(dtype=float)
    x = expanded(f) if len(f) else np.zeros((0, 8))
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(8), np.ones(8))
    rate = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if len(set(y)) < 2:
        weights = np.r_[np.log(rate / (1 - rate)), np.zeros(8)]
    else:
        # classes are sampled alike; weights bring back their rates among the labelled rows
        weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        weights = fit_logistic(np.c_[np.ones(len(x)), (x - center) / scale], y, weight, ridge=0.1)
    return Model(good, bad, center, scale, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; nulls are empty texts and get a score as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            f = np.array([sizes.of(t) for t in batch["text"]], dtype=float).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(f)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, learnt from labels whose remainder is not ``held_out``."""
    model = fit(docs, labels, remainder(divisor) != held_out, **bounds)
    out = score(docs, model)
    return out.select("doc_id", (remainder(divisor) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
