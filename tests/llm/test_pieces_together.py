"""Documents of a slice are cut together, each as if it were alone, and slices stay bounded."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import packing


def cases(rng):
    for _ in range(60):
        n_queues, window, quantum = rng.randrange(1, 6), rng.choice([7, 16, 64, 1024]), rng.choice([1, 3, 8, 16, 100])
        total, docs = [0] * n_queues, []
        for _ in range(rng.randrange(1, 25)):
            q, n = rng.randrange(n_queues), rng.choice([1, 2, rng.randrange(1, 50), rng.randrange(1, 600)])
            docs.append((q, total[q], n))
            total[q] += n
        yield packing.Schedule(total, None if rng.random() < 0.5 else [round(rng.uniform(0.01, 3), 2) for _ in total], quantum), docs, window


def test_documents_are_cut_together_as_alone():
    for schedule, docs, window in cases(random.Random(5)):
        alone = []
        for k, one in enumerate(docs):
            made = schedule.pieces(*[np.array([v]) for v in one], window)
            alone += [(k, *x) for x in zip(*[v.tolist() for v in made[1:]])]
        together = list(zip(*[v.tolist() for v in schedule.pieces(*map(np.array, zip(*docs)), window)]))
        assert together == alone
        # every token once, gapless in the stream, no piece across windows
        assert all(at // window == (at + size - 1) // window for _, _, size, at in together)
        begin = 0
        for at, size in sorted((at, size) for _, _, size, at in together):
            assert at == begin
            begin += size
        for k, (_, _, n) in enumerate(docs):
            mine = [(start, size) for doc, start, size, _ in together if doc == k]
            assert sum(size for _, size in mine) == n and all(a + b == c for (a, b), (c, _) in zip(sorted(mine), sorted(mine)[1:]))


@pytest.mark.parametrize("width", ["<u2", "<u4"])
def test_ids_of_pieces(width):
    ids = [np.arange(5), np.array([0]), np.arange(40_000, 40_007)]
    got = packing.piece_ids([x.astype(width).tobytes() for x in ids], np.array([5, 1, 7]), np.array([0, 0, 1, 2]), np.array([0, 3, 0, 2]), np.array([3, 2, 1, 5]))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [[0, 1, 2], [3, 4], [0], [40_002, 40_003, 40_004, 40_005, 40_006]]


def test_slices_are_bounded_by_rows_and_tokens():
    frame = pd.DataFrame({"n": [10, 10, 95, 300, 1, 1, 1, 99, 100], "k": range(9)})
    for rows in (1, 2, 4, 100):
        got = list(packing.slices(iter([frame, frame.iloc[:0], frame.iloc[2:4]]), rows, 100))
        assert [k for x in got for k in x["k"]] == [*range(9), 2, 3]
        assert all(0 < len(x) <= rows and (x["n"].sum() < 200 or x["n"].max() >= 100) and x.index[0] == 0 for x in got)
