"""Ownership of candidates counts owners, not rows."""

import collections
import random
import re
import string
import time

from plumewatch.llm.secrets import secrets

KEY = string.ascii_letters + string.digits
PATTERNS = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    (r"AKIA[A-Z0-9]{16,}", 0), (r"[0-9a-f]{24,}", 0), (r"[A-Za-z0-9+/_-]{20,}", 0)]


def test_one_owners_key_in_many_copies_is_live(spark):
    key, other = "sk_Ab12Cd34Ef56Gh78Ij90Kl12", "password=Zx98Yw76"
    rows = [(i, f"{key} {other}", "a") for i in range(1000)] + [(1000 + i, f"n{i} {key[::-1]}", "ab"[i % 2]) for i in range(4)]
    got = secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    live = [[(s.kind, s.live) for s in r.spans] for r in got if r.doc_id < 1000]
    assert live == [[("long", True), ("assign", True)]] * 1000
    assert [r.spans for r in got if r.doc_id >= 1000] == [[]] * 4


def _brute(rows):
    """All spans by plain regular expressions, and which of them look live."""
    held, found = collections.defaultdict(set), []
    for i, (_, text, owner) in enumerate(rows):
        hits = [(m.start(), m.end(), k, v) for k, (pattern, group) in enumerate(PATTERNS)
                for m in re.finditer(pattern, text) for v in [m.group(group)] if k or len(v) >= 6]
        spans = [h for h in hits if h[2] < 3]
        for start, end, _, v in [h for h in hits if h[2] == 3]:
            breaks = len(re.findall("[/_-]", v))
            key = re.search("[A-Za-z]", v) and (re.search("[0-9]", v) or (re.search("[A-Z]", v) and re.search("[a-z]", v)))
            if key and breaks <= max(3, len(v) / 8) and not any(
                    s < end and start < e for s, e, _, _ in spans):
                spans.append((start, end, 3, v))
        found.append(spans)
        for v in {s[3] for s in spans}:
            held[v].add(owner)
    return [sorted((s, k, e, v, len(held[v]) < 2) for s, e, k, v in spans if k < 3 or len(held[v]) < 2)
            for spans in found]


def _spans(spark, rows):
    got = secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    return {r.doc_id: [(s.start, s.rank, s.stop, s.secret, s.live) for s in r.spans] for r in got.collect()}


def test_spans_and_ownership_equal_brute_force(spark):
    rnd = random.Random(5)
    shared = ["".join(rnd.choices(KEY, k=rnd.randrange(18, 44))) for _ in range(40)]
    parts = [lambda: rnd.choice(shared), lambda: "".join(rnd.choices(KEY + "+/_-", k=rnd.randrange(15, 50))),
             lambda: f"{'x' * rnd.randrange(25)}token = {rnd.choice(shared)[:rnd.randrange(3, 30)]}",
             lambda: "AKIA" + "".join(rnd.choices("ABCXYZ234567", k=rnd.randrange(12, 20))),
             lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.randrange(20, 30))),
             lambda: "a/path/of/several/names/1", lambda: "żółw 🐢", lambda: "\n", lambda: '"api_key": "q"',
             lambda: "secret:" + "".join(rnd.choices("AKIA09af/", k=30))]
    rows = [(i, rnd.choice(["", " "]).join(rnd.choice(parts)() for _ in range(rnd.choice([0, 1, 3, 9, 40, 300]))),
             rnd.choice(["a", "a", "b", None])) for i in range(150)]
    assert _spans(spark, rows) == dict(enumerate(_brute(rows)))


def test_tens_of_thousands_of_matches_in_one_text(spark):
    row = [(1, " ".join(f"password=Zx{i:06d} Key{i:06d}Ab{i:06d}CdEfG" for i in range(25_000)), "a")]
    _spans(spark, [(1, "token=abcdefg", "a")])
    began = time.time()
    got = _spans(spark, row)
    assert time.time() - began < 20
    assert got == {1: _brute(row)[0]} and len(got[1]) == 50_000


def test_planted_keys_of_few_digits_are_found(spark):
    """Keys of 20 to 40 characters that one owner has each, beside copied examples, paths and word lists."""
    rnd = random.Random(6)
    planted = {i: "".join(rnd.choices(KEY, k=20 + i % 21)) for i in range(600)}
    example = "".join(rnd.choices(KEY, k=32))
    rows = [(i, f"plain words, usr/local/share/doc/part/of/it and one-more-of-those-long-words {example} "
                f"use {key} here", f"owner {i % 90}") for i, key in planted.items()]
    got = _spans(spark, rows)
    hits = sum([s[3] for s in got[i]] == [key] for i, key in planted.items())
    found = sum(len(spans) for spans in got.values())
    assert hits >= 0.99 * len(planted) and hits >= 0.99 * found


def test_counts_of_documents_and_owners_come_along(spark):
    rows = [(i, "token=abcdef99", "ab"[i % 2]) for i in range(6)] + [(9, "token=abcdef99 token=abcdef99", None)]
    got = secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(s.documents, s.owners, s.live) for r in got for s in r.spans} == {(7, 3, False)}
    assert [r for r in secrets(spark.createDataFrame([], "doc_id long, text string, source string")).collect()] == []
