import numpy as np

from tidemark.llm.set_join import most_shared


def test_low_bits_never_show_less_than_is_shared():
    rng = np.random.default_rng(3)
    for size in (0, 1, 30, 3_000, 90_000):
        for part in (0.0, 0.5, 0.8, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            own = rng.integers(0, 1 << 63, size // 3, dtype=np.uint64)
            b = np.unique(np.r_[a[: int(part * len(a))], own])
            shared = len(np.intersect1d(a, b))
            low = [np.unique(x.astype("<u2")) for x in (a, b)]
            assert most_shared(*low, len(a), len(b)) >= shared == most_shared(a, b, len(a), len(b))
            if size == 3_000 and not part:
                assert most_shared(*low, len(a), len(b)) < 0.2 * len(b)
