"""Every operator against a brute-force version, a library or held-out labels, on odd rows and on the smallest table."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, exact_dedup, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity
from tidemark.llm.bk_tree import Forest
from tidemark.llm.components import components
from tidemark.llm.suffix_array import Suffixes, previous_factors

BLANK = re.compile(r"[\x20\x09-\x0D]")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", ["docs", "small"])
def test_token_counts_as_the_library(name, request):
    df = request.getfixturevalue(name)
    t = token_counts.load(P.path("word_bpe_49k.json"))
    want = bag((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in texts(df))
    assert bag(token_counts.token_counts(df).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_frequent_runs_are_bounded_and_true(small):
    got = token_counts.frequent(small, table_size=20, fan_in=2)
    true = Counter(w for _, x in texts(small) for w in x.split())
    assert len(got) == 20 and all(true[w] >= n > 0 for w, n in got.items())


@pytest.mark.parametrize("name", ["docs", "small"])
def test_byte_bpe_as_the_library_and_back(name, request):
    df = request.getfixturevalue(name)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, np.array(t.encode_ordinary(x), dtype="<u4"), x) for i, x in texts(df)]
    assert bag(byte_bpe.round_trip(df).collect()) == bag((i, len(a), sha(a.tobytes()), sha(x.encode())) for i, a, x in ids)
    enc = byte_bpe.encoded(df)
    assert bag((r.doc_id, tuple(r.ids)) for r in enc.collect()) == bag((i, tuple(a.tolist())) for i, a, _ in ids)
    assert bag((r.doc_id, bytes(r.data)) for r in byte_bpe.decoded(enc).collect()) == bag((i, x.encode()) for i, _, x in ids)


def test_codec_on_random_strings():
    rng, c = random.Random(1), byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for _ in range(3000):
        x = "".join(rng.choice(" \t\n 　\x1c'aAéß1٣中🙂́.,!-s<|>") for _ in range(rng.randrange(40)))
        assert np.frombuffer(c.encode(x), dtype="<u4").tolist() == t.encode_ordinary(x) and c.decode(c.encode(x)) == x.encode()


def test_exact_dedup(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = index.append(docs).drop("row_hash").collect()
    groups = {}
    for i, x in texts(docs):
        groups.setdefault(BLANK.sub("", x), []).append((i, x))
    for i, keep, size, kept, sha in got:
        members = next(m for n, m in groups.items() if hashlib.sha256(n.encode()).hexdigest() == sha)
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert size == len(members) and keep == best[0] and (i, any(m[0] == i for m in members)) == (i, True) and (not kept or i == keep)
    assert len(got) == docs.count() and index.read().count() == len(groups)
    again = index.append(docs)
    assert not again.where("kept").count() and index.read().count() == len(groups)
    more = spark.createDataFrame([(99, "brand new"), (98, "one\ttwo")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.append(more).collect()} == {99: (99, True), 98: (7, False)}


def test_dropped_copies_keep_their_columns(spark, docs):
    out = exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, buckets=2))
    assert out.columns == docs.columns and out.select("text").distinct().count() == out.where("not (doc_id <=> 7)").count() + out.where("doc_id <=> 7").select("text").distinct().count()


def lines_brute(rows):
    seen, out, order = {}, {}, sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, x in order:
        lines = x.split("\n")
        worded = [k for k, s in enumerate(lines) if BLANK.sub("", s)]
        said = [lines[k].strip(" \t\x0b\x0c\r") for k in worded]
        gone = set()
        for j in range(len(said) - 2):
            if seen.setdefault(tuple(said[j : j + 3]), (i, j)) != (i, j):
                gone |= set(worded[j : j + 3])
        out[i, x] = (len(lines), len(gone), "\n".join(s for k, s in enumerate(lines) if k not in gone))
    return bag((i, *out[i, x]) for i, x in rows)


@pytest.mark.parametrize("name", ["docs", "small"])
def test_line_dedup(name, request):
    df = request.getfixturevalue(name).where("doc_id is null or doc_id <> 7")
    got = line_dedup.line_dedup(df).drop("row_hash")
    assert bag(got.collect()) == lines_brute(texts(df))


def simhash_brute(rows, width, radius=3):
    import xxhash

    def fp(x):
        w = [s for s in BLANK.split(re.sub("[A-Z]+", lambda m: m[0].lower(), x)) if s]
        sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    marks = [(i, fp(x)) for i, x in rows]
    label = {f: f for _, f in marks}
    while True:
        new = {a: min(label[b] for b in label if (a ^ b).bit_count() <= radius) for a in label}
        if new == label:
            break
        label = new
    first = {}
    for i, f in marks:
        first.setdefault(label[f], []).append((i is None, i or 0, i))
    return bag((i, f, min(first[label[f]], key=lambda v: v[:2])[2]) for i, f in marks)


@pytest.mark.parametrize("name", ["docs", "small"])
@pytest.mark.parametrize("width", [3, 5])
def test_simhash(name, width, request):
    df = request.getfixturevalue(name)
    got = simhash.near_duplicates(df, width=width).collect()
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == simhash_brute(texts(df), width)
    assert sum(r.first_row for r in got) >= len({r.component_id for r in got})


def test_links_through_small_shards_and_split_pieces(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
    same_block = (base & ~np.uint64(0xFFFF)) | np.uint64(7)
    points = np.unique(np.r_[base, near, same_block])
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    want = {tuple(sorted((int(points[i]), int(points[j])))) for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)) if i < j}
    for sizes in ({}, {"shard_size": 20, "piece_size": 10}, {"shard_size": 10**6, "piece_size": 40}):
        got = components(simhash.links(df, **sizes)).collect()
        class_of = {r.node % (1 << 64): r.root for r in got}
        assert {x for pair in want for x in pair} == set(class_of) and all(class_of[a] == class_of[b] for a, b in want)
    with pytest.raises(ValueError):
        simhash.links(df, radius=4)


def test_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    bucket = (points & np.uint64(1)).astype(np.int64)
    forest = Forest(points, bucket)
    for radius in (0, 1, 3):
        got = {p for q, n in forest.within(points, bucket, radius, slice_=64) for p in zip(q.tolist(), n.tolist())}
        assert got == {(i, j) for i in range(len(points)) for j in range(len(points)) if bucket[i] == bucket[j] and int(points[i] ^ points[j]).bit_count() <= radius}


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(links).select("root").distinct().count() == 1 and components(links).count() == 201
    assert components(links.limit(0)).count() == 0


def test_longest_factors():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, depth = int(rng.integers(1, 120)), 16
        data = bytes(rng.integers(97, 99, n).astype(np.uint8))
        starts = np.arange(max(n - depth + 1, 0))
        earlier, later = previous_factors(Suffixes(data, depth), starts)
        alike = lambda a, b: next((k for k in range(depth) if data[a + k] != data[b + k]), depth)  # noqa: B023, E731
        for i in starts:
            for got, others in ((earlier[i], starts[starts < i]), (later[i], starts[starts > i])):
                want = max((alike(i, j) for j in others), default=0)
                assert (got >= depth) == (want >= depth) and want - 8 < got <= want


def passages_brute(rows, first, length):
    count, firsts = Counter(), {}
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = x.encode()
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
            firsts.setdefault(b[p : p + length], (i, p))
    out = []
    for i, x in rows:
        b = x.encode()
        gone = np.zeros(len(b) + length + 1, dtype=int)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if count[w] > 1 and not (first and firsts[w] == (i, p)):
                gone[p] += 1
                gone[p + length] -= 1
        on = (np.cumsum(gone)[: len(b)] > 0).astype(int)
        out.append((i, len(b), int(on.sum()), int((np.diff(np.r_[0, on]) == 1).sum()), bytes(np.frombuffer(b, dtype=np.uint8)[on == 0])))
    return bag(out)


@pytest.mark.parametrize("keep", [None, "first"])
@pytest.mark.parametrize("shard_runs", [4000, 3])
@pytest.mark.parametrize("name", ["docs", "small"])
def test_suffix_dedup(name, keep, shard_runs, request):
    df = request.getfixturevalue(name).where("doc_id is null or doc_id <> 7")
    got = suffix_dedup.remove_repeats(df, keep=keep, shard_runs=shard_runs).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == passages_brute(texts(df), keep == "first", 200)


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 3_000)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdef \n") for _ in range(20_000))
    parts = [long[:9_000] + "é" + long[9_000:], long[4_321:15_000], "q" * 700]
    rows = list(suffix_dedup._blocks([p.encode() for p in parts], 200))
    assert max(sum(map(len, joined)) for joined, _, _ in rows) <= 3_400
    df = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == passages_brute(list(enumerate(parts)), False, 200)


def test_schedule_is_deficit_round_robin():
    rng = random.Random(3)
    for _ in range(120):
        n, q = rng.randrange(1, 6), rng.choice([1, 3, 16])
        tokens = [rng.randrange(0, 900) for _ in range(n)]
        weights = None if rng.random() < 0.5 else [rng.choice([1.0, 2.0, 0.5, 3.0]) for _ in range(n)]
        s = packing.Schedule(tokens, weights, q)
        w = [Fraction(x) for x in (s.full.tolist() if weights is None else weights)]
        order = sorted((Fraction(2 * i + 1, 2) / w[a], a, i) for a in range(n) for i in range(int(s.full[a])))
        place = {(a, i): r for r, (_, a, i) in enumerate(order)}
        for a in range(n):
            assert s.rank(a, np.arange(s.full[a])).tolist() == [place[a, i] for i in range(int(s.full[a]))]


@pytest.mark.parametrize("options", [{}, {"quantum": 100, "window": 256}, {"targets": {"s0": 3.0, "s1": 1.0, "s2": 1.0}, "quantum": 16}, {"max_queues": 1}])
def test_packing(docs, options):
    t = token_counts.load(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs, bucket_rows=4, **options).toPandas()
    window = options.get("window", 1024)
    want = Counter(tuple(t.encode(x, add_special_tokens=False).ids + [0]) for _, x in texts(docs))
    assert got["length"].sum() == sum(len(k) * n for k, n in want.items()) and (got["doc_tokens"] > 0).all()
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    sizes = g.groupby("sequence_id")["length"].sum()
    assert (sizes.iloc[:-1] == window).all() and sizes.iloc[-1] <= window and sizes.index.tolist() == list(range(len(sizes)))
    assert all(zlib.crc32(b) == c and len(b) == 4 * n for b, c, n in zip(got["ids"], got["ids_crc32"], got["length"]))
    single = got[~got["doc_id"].isin([7]) & got["doc_id"].notna()]
    for i, part in single.groupby("doc_id"):
        part = part.sort_values("start")
        assert (part["length"].cumsum() - part["length"] == part["start"]).all() and tuple(np.frombuffer(b"".join(part["ids"]), dtype="<u4").tolist()) in want


def test_packed_windows_keep_the_mixture(small):
    got = packing.pack(small, quantum=16).toPandas()
    shares = got.groupby("source")["length"].sum() / got["length"].sum()
    per = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).iloc[:-2]
    assert (np.abs(per.cumsum().div(1024 * (np.arange(len(per)) + 1), axis=0).iloc[10:] - shares).max() < 0.02).all()


def stats_brute(x):
    words = [w for w in BLANK.split(x) if w]
    lines = [s for s in x.split("\n") if BLANK.sub("", s)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


@pytest.mark.parametrize("name", ["docs", "small"])
def test_quality_counts(name, request):
    df = request.getfixturevalue(name)
    got = quality_rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert bag(r[:-2] for r in got) == bag((i, *stats_brute(x)) for i, x in texts(df))
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_fences_follow_their_stratum(spark):
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a") for i in range(300)]
    marked = [(1000 + i, " ".join(f"w{i}#{j}" for j in range(60)), "en", "b") for i in range(300)]
    odd = [(5000, " ".join(f"q#{j}" for j in range(60)), "en", "a"), (5001, " ".join(f"q#{j}" for j in range(60)), "en", "b"), (5002, " ".join(f"q{j}" for j in range(60)), "xx", "rare")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(plain + marked + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in plain + marked) and not got[5000] and got[5001] and got[5002]


def test_sketches_merge_by_addition(small):
    stats = quality_rules.text_stats(quality_rules._rows(small, "doc_id", "text", "lang", "source"), "doc_id long, row_hash long, text_ string, lang string, source string".replace("text_ string, ", "")).cache()
    whole = quality_rules.sketches(stats)
    halves = quality_rules.sketches(stats.where("doc_id % 2 = 0")).unionAll(quality_rules.sketches(stats.where("doc_id % 2 = 1")))
    assert bag(whole.collect()) == bag(halves.groupBy("lang", "source", "metric", "bucket").agg(F.sum("n")).collect())


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5


@pytest.mark.parametrize("score, label, least", [(toxicity.toxicity_scores, "toxic", 0.85), (quality_classifier.quality_scores, "quality", 0.95)])
def test_held_out_accuracy(spark, score, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and got["doc_id"].is_unique
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    y = held[label].to_numpy()
    assert auc(held["score"].to_numpy(), y) > least and (held["predicted"] == y).mean() > 0.95


def test_label_model_finds_precise_and_repeating_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    fires = lambda a, b: np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b).astype(float)
    one = fires(0.6, 0.01)
    votes = np.stack([one, one, one, fires(0.5, 0.01), fires(0.4, 0.01), fires(0.5, 0.5)], axis=1)
    model = toxicity.fit_label_model(votes, 0.3, np.array([0.9] * 5 + [0.5]))
    assert model.accuracy()[3] > 0.85 and abs(model.share[0] - 1 / 3) < 0.05 and model.share[3] > 0.9
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality_classifier.quality_scores])
def test_scores_of_odd_rows_and_few_labels(score, docs, empty, labels):
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len(score(docs, labels.limit(0)).collect()) == docs.count() and score(empty, labels).count() == 0


@pytest.mark.parametrize("run", [
    token_counts.token_counts, byte_bpe.round_trip, byte_bpe.encoded, line_dedup.line_dedup, simhash.near_duplicates, suffix_dedup.remove_repeats,
    packing.pack, quality_rules.quality_rules, lambda d: exact_dedup.DigestIndex(d.sparkSession, buckets=2).append(d),
])
def test_empty_tables(run, empty, docs):
    got = run(empty)
    assert got.count() == 0 and got.columns == run(docs).columns
