"""Personal data: base spans against the plain patterns, recovered reliabilities, added spans."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.queries import pii_digests

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def holds(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def plain(text):
    return [(kind, *m.span()) for kind, p in PLAIN for m in re.finditer(p, text) if holds(kind, m.group())]


def named(spans):
    return [(pii.KINDS[k], s, e) for k, s, e in spans]


def test_base_spans_as_the_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "25", "300", " ", "(", ")", "4111111111111111", "é", "٣", "x@y.z", "1.2.3.4", "+1 (555) 010-9999", "\n", "%"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert named(pii.base_spans(text)) == plain(text), text


def test_linear_on_long_runs():
    for unit in ("a", "1", "1.", "+", "a@", "-", "1 ", "A1", ":", "key=", "(at)", " at b dot c"):
        text = unit * (300_000 // len(unit))
        pii.proposed(text, pii.base_spans(text))


@pytest.mark.parametrize("name", ["docs", "small"])
def test_query_columns_as_brute_force(name, request):
    df = request.getfixturevalue(name)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        spans = plain(r.text or "")
        n = Counter(k for k, _, _ in spans)
        want[r.doc_id, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))] += 1
    got = pii_digests(pii.personal_data(df))
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    # every base span is in the spans, and no two spans that were added overlap
    for r in pii.personal_data(df).collect():
        assert not set(r.base) - set(r.spans)
        added = sorted((x.start, x.end) for x in set(r.spans) - set(r.base))
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
        assert all(x.end <= b.start or b.end <= x.start for x in set(r.spans) - set(r.base) for b in r.base)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    n, kinds = 60_000, rng.integers(0, 2, 60_000)
    truth = rng.random(n) < np.where(kinds == 0, 0.7, 0.2)
    said = np.array([[[0.3, 0.1, 0.6], [0.5, 0.1, 0.4], [0.6, 0.2, 0.2], [0.2, 0.2, 0.6]], [[0.3, 0.6, 0.1], [0.4, 0.55, 0.05], [0.5, 0.4, 0.1], [0.2, 0.6, 0.2]]])
    votes = np.stack([(rng.random(n)[:, None] > said[truth.astype(int), j].cumsum(axis=1)).sum(axis=1).clip(0, 2) for j in range(4)], axis=1)
    model = pii.estimate(kinds, votes, np.ones(n), n_kinds=2)
    assert np.abs(model.said - said).max() < 0.03
    assert np.abs(model.prior - [0.7, 0.2]).max() < 0.03


WORDS = "the of and tion ing report line about other water stone number field".split()


def test_added_spans_on_planted_rows(spark):
    """Spelt addresses, local phones, secrets and a card beside its copy are added; look-alikes and clean rows stay."""
    rng = random.Random(7)
    card = lambda: next(d for d in (f"4{rng.randrange(10**15):015d}" for _ in iter(int, 1)) if pii.luhn(d))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    make = {
        "email": lambda: f"jo.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "card": card,
        "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}", "secret": lambda: f"password={hexes(18)}",
        "spelt": lambda: f"mail jo{rng.randrange(99)} at mail dot example dot com", "local": lambda: f"call ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}",
        "token": lambda: f'token = "{hexes(40)}"', "twice": lambda: " ".join([card()] * 2), "time": lambda: f"time {rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}",
    }
    fill = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 20)))
    rows = [(i, f"{fill()} {make[k]()} {fill()}", k) for i, k in enumerate(k for k in make for _ in range(60))]
    rows += [(len(rows) + i, fill(), "clean") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, planted string").repartition(4)
    hit = {r.doc_id: len(r.spans) for r in pii.personal_data(df).collect()}
    share = lambda kind: np.mean([hit[i] > 0 for i, _, k in rows if k == kind])
    for kind in ("email", "ip", "card", "phone", "secret", "spelt", "local", "token", "twice"):
        assert share(kind) >= 0.9, (kind, share(kind))
    assert share("clean") == 0 and share("time") <= 0.1


def test_empty_table_and_clashing_names(spark, empty):
    assert pii.personal_data(empty).count() == 0
    df = spark.createDataFrame([(1, "a@b.cd", 3, "x"), (None, None, 4, "y")], "doc_id long, text string, votes int, candidates string")
    assert sorted(len(r.spans) for r in pii.personal_data(df).collect()) == [0, 1]
    assert pii.personal_data(df.where(F.col("doc_id").isNull())).select(F.size("spans")).collect()[0][0] == 0
