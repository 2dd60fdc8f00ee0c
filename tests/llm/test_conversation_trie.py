"""The prefix trie against brute force on odd conversations, with slices of every size."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import conversation_trie as ct
from tidemark.llm.queries import oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    low = {node: min(c for c, _ in m) for node, m in members.items()}
    ends = {node: hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest() for node, m in members.items()}
    return Counter((low[n], len(n), low[n[:-1]] if n else None, len(m), len(kids[n]), leaves[n], saved[n], ends[n]) for n, m in members.items())


def nodes(df):
    return Counter(tuple(r) for r in ct.conversation_nodes(df).select(*NAMES).collect())


def talk(seed, n=260, words=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue
        for t in range(rng.randrange(longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, *(f"said {i}" for i in range(words))])))
    return rows


ODD = [
    (300, None, "user", "first"), (300, 1, None, None), (300, 1, None, None), (300, 1, "a", "tie"), (300, 2, "user", "ünïc🙂de"), (301, 1, "user", "first"), (None, 1, "user", "lost"),
    (-7, 0, "user", "minus"), (-100, 0, "user", "first"), (399, 0, "user", "x" * 50_000),
]
DEEP = [(c, t, "user", f"t{t}") for c in range(1000, 1040) for t in range(3 * (c - 1000) + 1)] + [(1100, t, "user", f"t{t}") for t in range(300)]


@pytest.mark.parametrize("size", [10_000, 7, 1])
@pytest.mark.parametrize("rows", [talk(1), talk(2, words=1) + ODD, DEEP], ids=["random", "odd", "deep"])
def test_as_brute_force_in_slices_of_every_size(spark, rows, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_many_copies_are_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 4000) if c % 3]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_sql_twin_on_odd_rows(spark):
    rows = talk(4) + ODD
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(oracle_sql()["op12_conversation_trie"])
    at = [[d[0] for d in cur.description].index(n) for n in NAMES]
    assert Counter(tuple(r[i] for i in at) for r in cur.fetchall()) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert ct.conversation_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "hi", "k", 5, "p")], SCHEMA + ", key string, depth int, path string")
    assert nodes(df) == brute([(1, 0, "user", "hi")])
