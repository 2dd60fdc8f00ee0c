"""Token alignment against whole-text library calls and all pairs by brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import token_alignment as ta

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(P.path(A), P.path(B))


def whole(pair, text):
    """Groups and linked id pairs of one text from its whole encodings, every pair of tokens compared."""
    if not text:
        return None
    (a,), (b,) = [e.ids for e in pair.a.encode_batch([" " + text], add_special_tokens=False)], [pair.b.encode(text)]
    left, right = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
        return None
    spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
    x, y = spans(left), spans(right)
    links = [(a[i], b[j]) for i, (s, e) in enumerate(x) for j, (u, v) in enumerate(y) if max(s, u) < min(e, v)]
    cuts = sorted({e for _, e in x} & {e for _, e in y})
    said, low = [], 0
    for cut in cuts:
        inside = lambda ids, parts: ",".join(str(i) for i, (s, e) in zip(ids, parts) if low <= s and e <= cut)  # noqa: B023, E731
        said.append(inside(a, x) + "|" + inside(b, y))
        low = cut
    return len(a), len(b), len(cuts), links, ";".join(said)


def brute(pair, rows):
    done = [(i, whole(pair, t)) for i, t in rows]
    held = Counter(p for _, w in done if w for p in set(w[3]))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for i, w in done:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, *w[:3], len(w[3]), sum(held[p] == top[p[0]] for p in w[3]), sum(held[p] for p in w[3]), hashlib.sha256(w[4].encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1 << 16, 50, 0])
def test_counts_as_brute_force(spark, docs, pair, hot):
    odd = [
        (1, "x▁ y"), (2, " lead"), (3, "trail "), (4, "  two"), (5, " "), (6, "a\x00b c"), (7, "<s> </s> <unk> <0x41> <|endoftext|>"), (8, "  nb sp 　wide x"),
        (9, "é ẛ̣ ﬁ ①"), (10, "tab\tand\nline\r\n end"), (11, "🙂👩‍👩‍👧 日本語 한국어 x"), (12, None), (13, "a b  c   d    e"), (14, "it's I'll 'tis don't"), (None, "same"), (15, "same"), (15, "same"),
    ]
    some = [(r.doc_id, (r.text or "")[:400]) for r in docs.collect()]
    rows = odd + some
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ta.alignment_counts(df, hot=hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == brute(pair, [(i, t or "") for i, t in rows])


def test_units_give_the_whole_texts_tokens(pair, small):
    aligner = ta.Aligner(pair, room=20)
    texts = [r.text or "" for r in small.select("text").limit(200).collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice(" \n\t.,'aAbé1日 ▁🙂s") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text, got in zip(texts, aligner.batch(texts)):
        ids_a, ids_b = [i[0] for i in pair.encode([text])] if text else ([], [])
        joined = b"".join(pair.a_bytes[i] for i in ids_a), b"".join(pair.b_bytes[i] for i in ids_b)
        if not text or joined != ((" " + text).encode(),) * 2:
            assert got[:5] == (0, 0, 0, 0, "")
            continue
        groups = [g.split("|") for g in got[4].split(";")]
        assert [int(i) for g in groups for i in g[0].split(",")] == ids_a
        assert [int(i) for g in groups for i in g[1].split(",")] == ids_b
        assert got[:3] == (len(ids_a), len(ids_b), len(groups))


def test_gallop_and_links_on_random_ends():
    rng = random.Random(5)
    for _ in range(500):
        end = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randrange(end)), end}) for _ in range(2))
        x, y = np.array(a), np.array(b)
        i, j = ta.common_ends(x, y, np.zeros(len(a), int), np.zeros(len(b), int))
        assert list(zip(i.tolist(), j.tolist())) == [(a.index(e), b.index(e)) for e in sorted(set(a) & set(b))]
        group = np.concatenate([[0], j + 1])[np.searchsorted(i, np.arange(len(a)))]
        first, many = ta.overlaps(x, y, group)
        span = lambda e: list(zip([0, *e], e))
        want = [(i, j) for i, (s, t) in enumerate(span(a)) for j, (u, v) in enumerate(span(b)) if max(s, u) < min(t, v)]
        assert [(i, f + k) for i, (f, n) in enumerate(zip(first.tolist(), many.tolist())) for k in range(n)] == want
        low, at = np.array([rng.randrange(len(b)) for _ in a]), np.array([rng.randrange(70) for _ in a])
        assert ta.gallop(y, low, at).tolist() == [next((k for k in range(s, len(b)) if b[k] >= e), len(b)) for s, e in zip(low, at)]


def test_empty_table_and_clashing_names(spark, empty):
    assert ta.alignment_counts(empty).count() == 0
    df = spark.createDataFrame([(1, "one two", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, pair int, row string")
    assert sorted(r.n_a > 0 for r in ta.alignment_counts(df).collect()) == [False, True]
    assert {r.doc_id: r.groups for r in ta.aligned(df).collect()}[2] == ""


def test_runs_of_texts_are_bounded_by_number_and_length():
    from tidemark.llm.token_alignment import slices

    assert list(slices([], 3, 10)) == []
    assert list(slices([1, 1, 1, 1], 3, 10)) == [(0, 3), (3, 4)]
    assert list(slices([4, 6, 1, 99, 0, 0], 9, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
