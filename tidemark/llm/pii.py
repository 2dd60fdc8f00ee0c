"""Personal data by weak supervision.

Base spans (e-mail and network addresses, card and phone numbers) follow fixed patterns and always stay.  Wider patterns
propose more spans, of secrets too.  Every proposed span, base spans included, gets a vote (yes, no or none) of eight labelers:
patterns, gazetteers and the words around it.  Expectation-maximisation over the counts of all vote patterns of
the corpus estimates, without labels, how often each labeler says what about true and false spans, and how many spans of a kind are true.  Its
posteriors train the final span classifier, a logistic regression over votes and the form of a span, which decides what is added.

What reaches the driver is counts: at most ``5 * 3**8`` vote patterns for the reliabilities, all of them, and for the
classifier at most ``n_fit`` different (kind, votes, form) patterns with their counts, those of smallest hash.

Defined results: a null text is empty and has no span; every row gets its own answer; an added span never overlaps a base span or
an added one before it; without any proposed span nothing is added.  All patterns run in linear time on texts of any length.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.labelled import fit_logistic, sigmoid
from tidemark.session import settled, spread

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
Span = tuple[int, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def only_digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def small_parts(dotted: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in dotted.split("."))


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` in code points, by kind and start.

    The address pattern is anchored at its sign and the dotted one at the first digit of a run, which finds
    the same leftmost spans without trying every start.
    """
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                found.append((EMAIL, start, free))
        at = text.find("@", at + 1)
    found += [(IP, *m.span()) for m in _DOTTED.finditer(text) if small_parts(m.group())]
    found += [(CARD, *m.span()) for m in _DIGITS.finditer(text) if 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    found += [(PHONE, *m.span()) for m in _PLUS.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return found


# ---- wider patterns -------------------------------------------------------------------------------------------------

_SPELT_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| at ")
_SPELT_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_SPELT_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_LONG_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])00[1-9][0-9]{8,12}(?![0-9])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|auth)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'#$%&*,;<>]{6,200})", re.IGNORECASE)
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}")

# Forms of issued keys, endings of host names, first digits of card issuers, calling codes, words around spans.
KEY_FORM = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
HOST_ENDINGS = frozenset("com org net edu gov info biz io eu de fr es uk us ca it nl at ch be pt pl se no dk fi ie jp cn in au br mx".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "30", "60", "62", "64", "65", "35", "22", "23", "24", "25", "26", "27")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
CUES = (
    ("mail", "e-mail", "contact", "write", "reach", "correo", "courriel"), ("ip", "host", "server", "address", "addr", "client", "from"),
    ("card", "visa", "credit", "mastercard", "payment", "tarjeta", "karte", "carte"), ("phone", "tel", "call", "mobile", "fax", "dial", "cell"),
    ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api", "auth", "credential"),
)
COUNTER_CUES = frozenset("version release build section chapter figure table isbn issn doi page pages order invoice sku commit revision checksum sha md5 time".split())
STAND_INS = frozenset("foo bar test user name nobody noreply no-reply sample dummy changeme placeholder".split())

_WORD = re.compile(r"[a-z][a-z-]*")
#: Code points read before a span.
BEFORE = 32


def proposed(text: str, base: list[Span]) -> list[Span]:
    """Base spans and what wider patterns find beside them, without overlaps within a kind."""
    more: list[Span] = []
    for m in _SPELT_AT.finditer(text):
        low = max(0, m.start() - 64)
        left, right = _SPELT_LEFT.search(text[low : m.start()]), _SPELT_RIGHT.match(text, m.end())
        if left and right and (m.group() != " at " or " dot " in right.group()):
            more.append((EMAIL, low + left.start(), right.end()))
    more += [(IP, *m.span()) for m in _COLONS.finditer(text) if m.end() - m.start() > 3]
    more += [(CARD, *m.span()) for m in _LONG_RUN.finditer(text)]
    more += [(PHONE, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    secrets = [m.span(1) for m in _ASSIGNED.finditer(text)]
    secrets += [m.span() for m in _MIXED.finditer(text) if not m.group().isalpha() and not m.group().isdecimal()]
    more += [(SECRET, s, e) for s, e in secrets]
    taken = sorted(base, key=lambda x: x[1:])
    kept, i = list(base), 0
    last = [-1] * len(KINDS)
    for kind, s, e in sorted(more, key=lambda x: (x[1], -x[2], x[0])):
        while i < len(taken) and taken[i][2] <= s:
            i += 1
        if s >= last[kind] and not any(b < e and s < c for _, b, c in taken[i : i + 4]):
            kept.append((kind, s, e))
            last[kind] = e
    return kept


# ---- labelers: 0 says nothing, 1 yes, 2 no --------------------------------------------------------------------------


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def pattern_strict(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    return 1 if is_base or (kind == SECRET and KEY_FORM.fullmatch(value)) else 0


def pattern_check(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    if kind == CARD:
        ok = luhn(only_digits(value))
    elif kind == IP:
        try:
            ok = bool(ipaddress.ip_address(value))
        except ValueError:
            ok = False
    elif kind == PHONE:
        ok = 9 <= len(only_digits(value)) <= 15
    elif kind == EMAIL:
        ok = value.rsplit(".", 1)[-1].strip(" )]}").rsplit(" ", 1)[-1].isalpha()
    else:
        ok = entropy(value) >= 2.8
    return 1 if ok else 2


def pattern_layout(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    if kind == CARD:
        sizes = [len(x) for x in re.split("[ -]", value)]
        return 1 if len(sizes) == 1 or (set(sizes[:-1]) == {4} and sizes[-1] <= 4) or sizes == [4, 6, 5] else 2
    if kind == IP:
        return 2 if any(len(p) > 1 and p[0] == "0" for p in value.split(".")) else 0
    if kind == PHONE:
        return 1 if value.count("(") == value.count(")") and ".." not in value and "  " not in value else 2
    if kind == EMAIL:
        return 1 if any(c.isalpha() for c in value.split("@")[0]) else 2
    return 1 if any(c.isdecimal() for c in value) and any(c.isalpha() for c in value) else 2


def gazetteer_known(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    if kind == EMAIL:
        return 1 if re.split(r"[^A-Za-z0-9-]+", value.lower().strip(")]} "))[-1] in HOST_ENDINGS else 0
    if kind == CARD:
        return 1 if value.startswith(ISSUERS) else 2
    if kind == PHONE:
        return 1 if only_digits(value).removeprefix("00").startswith(CALLING_CODES) and value[0] in "+0" else 0
    if kind == SECRET:
        return 1 if KEY_FORM.match(value) else 0
    return 2 if value.startswith(("0.", "127.", "255.", "::1")) else 0


def gazetteer_stand_in(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    digits = only_digits(value)
    if kind in (CARD, PHONE) and (len(set(digits)) <= 2 or digits in "01234567890123456789"):
        return 2
    return 2 if kind in (EMAIL, SECRET) and re.split("[@ ([{.]", value.lower())[0] in STAND_INS else 0


def context_cue(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    return 1 if any(w in CUES[kind] for w in before) else 0


def context_counter(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    return 2 if any(w in COUNTER_CUES for w in before) else 0


def context_edges(kind: int, value: str, is_base: bool, before: list[str], edge: str) -> int:
    return 2 if any(c.isalnum() or c == "_" for c in edge) else 0


LABELERS = (pattern_strict, pattern_check, pattern_layout, gazetteer_known, gazetteer_stand_in, context_cue, context_counter, context_edges)
FORM_BITS = 9


def form_of(value: str, left: str) -> int:
    """Length, kinds of characters and what stands before, as bits."""
    digits = sum(c.isdecimal() for c in value)
    bits = (
        len(value) > 10, len(value) > 16, len(value) > 32, 2 * digits > len(value), 4 * digits > 3 * len(value), value.lower() != value,
        any(not c.isalnum() for c in value), left[-1:] in ("=", ":", '"', "'"), left[-1:] in ("", "\n"),
    )
    return sum(1 << i for i, on in enumerate(bits) if on)


def judged(text: str, span: Span, is_base: bool) -> tuple[int, int]:
    """Votes of all labelers as one number in base 3, and the form bits."""
    kind, s, e = span
    left, value = text[max(0, s - BEFORE) : s], text[s:e]
    before, edge = _WORD.findall(left.lower())[-4:], left[-1:] + text[e : e + 1]
    votes = 0
    for labeler in LABELERS:
        votes = 3 * votes + labeler(kind, value, is_base, before, edge)
    return votes, form_of(value, left)


def vote_table(votes: np.ndarray) -> np.ndarray:
    """One column per labeler from the numbers in base 3."""
    return np.stack([votes // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], axis=-1)


# ---- label model and classifier -------------------------------------------------------------------------------------


@dataclass
class Reliability:
    """``said[c, j, v]``: how often labeler j says v about spans of truth c; ``prior[k]``: share of true spans of kind k."""

    said: np.ndarray
    prior: np.ndarray

    def posterior(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        evidence = (np.log(self.said[1, j, votes]) - np.log(self.said[0, j, votes])).sum(axis=1)
        return sigmoid(evidence + np.log(self.prior[kinds]) - np.log(1 - self.prior[kinds]))


def estimate(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, n_kinds: int = len(KINDS), rounds: int = 200) -> Reliability:
    """Expectation-maximisation over counted vote patterns, from the start that more yes than no is true."""
    yes, no = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    q = np.where(yes > no, 0.9, 0.1)
    model = None
    for _ in range(rounds):
        classes = np.stack([(1 - q) * counts, q * counts])
        said = np.stack([[np.bincount(votes[:, j], weights=w, minlength=3) for j in range(votes.shape[1])] for w in classes]) + 0.5
        said /= said.sum(axis=2, keepdims=True)
        true, every = (np.bincount(kinds, weights=w, minlength=n_kinds) for w in (classes[1], counts))
        model = Reliability(said, (true + 1) / (every + 2))
        new = model.posterior(kinds, votes)
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return model


def design(kinds: np.ndarray, votes: np.ndarray, forms: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(kinds))] + [kinds == k for k in range(len(KINDS))] + [votes[:, j] == v for j in range(votes.shape[1]) for v in (1, 2)]
    return np.stack([*columns, *((forms >> b & 1) for b in range(FORM_BITS))], axis=1).astype(float)


@dataclass
class Classifier:
    """Weights of the final classifier over kind, votes and form; ``reliability`` is what it was trained from."""

    weights: np.ndarray
    reliability: Reliability

    def scores(self, kinds: np.ndarray, votes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        return sigmoid(design(kinds, vote_table(votes), forms) @ self.weights)


_CANDIDATE = "array<struct<kind:int,start:int,end:int,votes:int,form:int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_base, candidates``: per row its base spans, then the other proposed spans, with votes and form."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, rows = [], []
            for text in batch["text"]:
                base = base_spans(text)
                spans = proposed(text, base)
                sizes.append(len(base))
                rows.append([(*x, *judged(text, x, i < len(base))) for i, x in enumerate(spans)])
            names = ("kind", "start", "end", "votes", "form")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_base": sizes, "candidates": [[dict(zip(names, x)) for x in r] for r in rows]})

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return spread(texts).mapInPandas(run, f"doc_id {kind}, n_base int, candidates {_CANDIDATE}")


def fit(found: DataFrame, n_fit: int = 20_000) -> Classifier | None:
    """Reliabilities from the votes on every candidate, the classifier from at most ``n_fit`` counted patterns; ``None`` without candidates."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    counts = settled(spans.groupBy("kind", "votes", "form").agg(F.count("*").alias("n")), "pii_votes")
    said = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).toPandas().sort_values(["kind", "votes"])
    if said.empty:
        return None
    model = estimate(said["kind"].to_numpy(), vote_table(said["votes"].to_numpy()), said["n"].to_numpy(dtype=float))
    some = counts.orderBy(F.xxhash64("kind", "votes", "form"), "kind", "votes", "form").limit(n_fit).toPandas()
    kinds, votes, forms = (some[c].to_numpy() for c in ("kind", "votes", "form"))
    table = vote_table(votes)
    weight = some["n"].to_numpy(dtype=float)
    # counts are damped, or a few very common patterns alone would set the weights
    return Classifier(fit_logistic(design(kinds, table, forms), model.posterior(kinds, table), np.sqrt(weight), ridge=0.1), model)


def personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``kind, start, end`` (code points, end exclusive) by kind and start; ``base`` is part of ``spans``."""
    found = settled(candidates(docs, id_col, text_col), "pii_candidates")
    model = fit(found, **bounds)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int, int], bool] = {}
        for batch in batches:
            rows = [[(c["kind"], c["start"], c["end"], c["votes"], c["form"]) for c in r] for r in batch["candidates"]]
            fresh = list({(k, v, f) for r in rows for k, _, _, v, f in r} - known.keys())
            if fresh:
                known.update(zip(fresh, (model.scores(*np.array(fresh).T) >= threshold).tolist()))
            base, spans = [], []
            for n, r in zip(batch["n_base"], rows):
                kept, end = [x[:3] for x in r[:n]], -1
                base.append(kept[:])
                for k, s, e, v, f in sorted(r[n:], key=lambda x: (x[1], -x[2], x[0])):
                    if s >= end and known[k, v, f]:
                        kept.append((k, s, e))
                        end = e
                spans.append(sorted(kept))
            told = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in r] for r in side] for side in (base, spans)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": told[0], "spans": told[1]})

    span = "array<struct<kind:string,start:int,end:int>>"
    return found.mapInPandas(run, f"doc_id {kind}, base {span}, spans {span}")
