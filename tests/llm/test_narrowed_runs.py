"""What reaches the suffix array of a shard: only strings that may be equal, and the same matches as without that."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_array import Suffixes, previous_factors

LENGTH = 200


def shard(texts):
    """Runs of all texts whose anchors are met twice, as the shards get them."""
    out = []
    for i, data in enumerate(texts):
        n = len(data) - LENGTH + 1
        for lo, hi, anchor, pos in zip(*map(np.ndarray.tolist, suffix_dedup.runs(np.frombuffer(data, dtype=np.uint8), np.arange(n), LENGTH))):
            out.append((False, i, 0, anchor, lo, hi, pos, data[lo : hi + LENGTH]))
    found = pd.DataFrame(out, columns=["z", "doc_id", "row_hash", "anchor", "lo", "hi", "pos", "bytes"]).drop_duplicates(["anchor", "bytes"])
    return found[found.groupby("anchor")["anchor"].transform("size") > 1]


def noise(rng, n):
    return bytes(rng.randrange(97, 123) for _ in range(n))


def long_matches(contexts, first):
    strings = [(x[k : k + LENGTH], (i, lo + k)) for i, lo, x in zip(contexts["doc_id"], contexts["lo"], contexts["bytes"]) for k in range(len(x) - LENGTH + 1)]
    places: dict[bytes, list] = {}
    for s, place in sorted(strings, key=lambda v: v[1]):
        places.setdefault(s, []).append(place)
    return {p for at in places.values() if len(at) > 1 for p in at[first:]}


@pytest.mark.parametrize("first", [False, True])
def test_matches_are_those_of_brute_force(first):
    rng = random.Random(7)
    for size in (150, 199, 200, 201, 240, 700):
        common = noise(rng, size)
        texts = [noise(rng, rng.randrange(0, 300)) + common + noise(rng, rng.randrange(0, 300)) for _ in range(9)] + [b"ab" * 300, b"ab" * 250 + b"c" * 210]
        contexts = shard([t for t in texts if len(t) >= LENGTH])
        got = suffix_dedup.shard_matches(contexts, LENGTH, first)
        assert {(r.doc_id, p) for r in got.itertuples() for p in range(r.a, r.b + 1)} == long_matches(contexts, first), size


def test_only_strings_that_may_be_equal_are_ranked(monkeypatch):
    rng = random.Random(8)
    common = noise(rng, 120)
    texts = [noise(rng, 400) + common + noise(rng, 400) for _ in range(40)]
    contexts, seen = shard(texts), []
    assert len(contexts) > 10
    monkeypatch.setattr(suffix_dedup, "Suffixes", lambda data, depth: seen.append(len(data)) or Suffixes(data, depth))
    assert not len(suffix_dedup.shard_matches(contexts, LENGTH, False)) and seen == [0]
    # two of them alike around the common part: their strings are ranked, the others' are not
    twins = [*texts, texts[0][:330] + noise(rng, 3) + texts[0][333:800] + noise(rng, 120)]
    got = suffix_dedup.shard_matches(shard(twins), LENGTH, False)
    assert set(got["doc_id"]) == {0, 40} and seen[1] < sum(map(len, shard(twins)["bytes"])) / 4


def test_matches_under_the_least_count_as_none():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, depth = int(rng.integers(1, 120)), 16
        suffixes = Suffixes(bytes(rng.integers(97, 99, n).astype(np.uint8)), depth)
        starts = np.arange(max(n - depth + 1, 0))
        every = previous_factors(suffixes, starts)
        for least in (8, depth):
            for a, b in zip(previous_factors(suffixes, starts, least), every):
                assert a.tolist() == np.where(b >= least, b, 0).tolist()
