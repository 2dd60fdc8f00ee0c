"""Documents that share few shingles by chance do not meet in the near-copy stage, however many there are, and no near copy is lost for it."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import set_join
from tidemark.session import settled, temporary


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_chance_shingles_ask_for_no_pairs(spark, monkeypatch):
    """Every two of 60 documents have one shingle of 531 in common, in a place of its own: 1,770 pairs, none to be compared."""
    n, parts = 60, {k: [] for k in range(60)}
    for a, b in itertools.combinations(range(n), 2):
        phrase = [f"p{a}x{b}y{i}" for i in range(5)]
        for k, other in ((a, b), (b, a)):
            parts[k].append([*phrase, *[f"own{k}z{other}y{i}" for i in range(4)]])
    rows = [(k, " ".join(itertools.chain(*random.Random(k).sample(x, len(x))))) for k, x in parts.items()]
    rows.append((n, rows[0][1] + " and some more words at the end"))
    asked, confirmed = [], set_join._confirmed
    monkeypatch.setattr(set_join, "_confirmed", lambda pairs, *rest: asked.append(pairs.distinct().count()) or confirmed(pairs, *rest))
    monkeypatch.setattr(set_join, "alike", lambda marks: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.component_id for r in set_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: k for k in range(n)}, n: 0}
    assert sum(asked) <= 2


@pytest.mark.parametrize("vocabulary", [3, 12, 400])
def test_join_alone_as_brute_force(spark, monkeypatch, vocabulary):
    """Without fingerprints: short and long sets, shingles in many documents, copies around the threshold."""
    rng, texts = random.Random(vocabulary), []
    for _ in range(40):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 14, 30, 120]))]
        texts.append(words)
        for _ in range(3):
            now = list(words)
            for _ in range(rng.randrange(1 + len(now) // 30)):
                now[rng.randrange(len(now))] = f"w{rng.randrange(vocabulary)}"
            texts.append(now[: len(now) - rng.randrange(1 + len(now) // 12)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    monkeypatch.setattr(set_join, "alike", lambda marks: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.component_id for r in set_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(k for k, x in enumerate(label) if x == label[i]) for i in range(len(rows))}


def test_sketches_never_show_less_than_is_shared():
    rng = np.random.default_rng(7)
    for size in (0, 1, 63, 64, 65, 900, 5_000):
        for part in (0.0, 0.5, 0.8, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.r_[a[: int(part * len(a))], rng.integers(0, 1 << 63, size // 4, dtype=np.uint64)])
            shared = len(np.intersect1d(a, b))
            assert set_join.most_by_sketch(set_join.sketch(a), set_join.sketch(b), len(a), len(b)) >= shared
            c = rng.integers(0, 1 << 63, len(a), dtype=np.uint64)
            if size >= 900:
                assert set_join.most_by_sketch(set_join.sketch(a), set_join.sketch(c), len(a), len(c)) < 0.85 * len(a)


def test_early_and_later_shingles_are_the_order():
    rng = np.random.default_rng(8)
    for size in (0, 1, 2, 7, 300):
        hashes = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        common = hashes[::5]
        early, late = set_join.in_slices(hashes, common, np.arange(len(common)) + 3, 80)
        ordered = set_join.in_order(hashes, common, np.arange(len(common)) + 3)
        got = np.concatenate([*early, late])
        assert len(early) == set_join.SLICES and got.tolist() == ordered[: len(got)].tolist() and len(got) >= set_join.n_prefix(len(hashes), 80)


def test_shuffle_files_go_with_their_query(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x.rsplit("/", 1)[1] for x in every.split("\n") if "/shuffle_" in x}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(setting), files()
    with temporary(spark):
        assert settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
        for _ in range(50):
            left = files() - there
            if not left:
                break
            time.sleep(0.1)
        assert not left
    assert spark.conf.get(setting) == before
