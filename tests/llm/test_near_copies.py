"""The near-duplicate stage: every pair at a Jaccard similarity of 0.8 of five-word shingles, none below."""

import random

import corpus_pipeline
import numpy as np
import pytest
from tidemark import session
from tidemark.llm import set_join


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, least, rng):
    """The most single-word edits, at random places, that keep the similarity."""
    now = list(words)
    for i in rng.sample(range(len(words)), len(words)):
        trial = list(now)
        trial[i] = f"new{rng.randrange(10**9)}"
        if jaccard(" ".join(words), " ".join(trial)) < least:
            break
        now = trial
    return " ".join(now)


@pytest.fixture(scope="module")
def planted():
    """Originals, and copies just at or above 0.8, 0.85 and 0.9 and just below 0.8."""
    rng, rows = random.Random(11), []
    for k in range(120):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        far = edited(words, 0.7, rng)
        rows += [(5 * k, " ".join(words))] + [(5 * k + j, edited(words, s, rng)) for j, s in ((1, 0.8), (2, 0.85), (3, 0.9))] + [(5 * k + 4, far)]
    return rows


def components_brute(rows, least):
    label = {i: i for i, _ in rows}
    near = [(a, b) for n, (a, x) in enumerate(rows) for b, y in rows[n + 1 :] if a // 5 == b // 5 and jaccard(x, y) >= least]
    while True:
        old = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label


def test_copies_at_the_threshold_go_and_others_stay(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    want = components_brute(planted, 0.8)
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect()}
    assert kept == set(want.values())
    assert all(5 * k + j not in kept for k in range(120) for j in (1, 2, 3)) and any(5 * k + 4 in kept for k in range(120))


def test_components_as_brute_force(spark, docs, small):
    for df in (docs, small):
        rows = [(i, r.doc_id, r.text or "") for i, r in enumerate(df.select("doc_id", "text").collect())]
        label = list(range(len(rows)))
        sets = [shingles(x) for _, _, x in rows]
        near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        while True:
            old = list(label)
            for a, b in near:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                break
        ids = {}
        for (_, i, _), c in zip(rows, label):
            ids.setdefault(c, []).append((i is None, i or 0, i))
        want = sorted((str(i), str(min(ids[c], key=lambda v: v[:2])[2])) for (_, i, _), c in zip(rows, label))
        got = set_join.near_duplicates(df).collect()
        assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


def test_common_shingles_come_last():
    hashes, common = np.array([1, 5, 9, 12], dtype=np.uint64), np.array([5, 9], dtype=np.uint64)
    assert set_join.in_order(hashes, common, np.array([7, 3])).tolist() == [1, 12, 9, 5]


def test_fingerprints_in_bk_trees_come_first(spark, monkeypatch, tmp_path):
    """Near copies that the fingerprints find are linked through them, and the tables in between are gone afterwards."""
    rng = random.Random(5)
    words = [f"v{rng.randrange(5000)}" for _ in range(900)]
    rows = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(12)] + [(50 + k, " ".join(rng.sample(words, 80))) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, asked, inner, confirmed = [], [], set_join.simhash.links, set_join._confirmed
    monkeypatch.setattr(set_join.simhash, "links", lambda fps: found.append(fps.count()) or inner(fps))
    monkeypatch.setattr(set_join, "_confirmed", lambda pairs, *rest: asked.append(pairs.distinct().count()) or confirmed(pairs, *rest))
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect()}
    assert kept == {0, *range(50, 58)} and len(found) == 1 and found[0] > 8
    assert asked[0] >= 11 and asked[1:] == [0, 0]
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["near"]
