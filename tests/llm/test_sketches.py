"""Bottom-k sketches against exact sets of shingles."""

import base64
import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumewatch.llm import sketches
from tests.llm import brute
from tests.llm.test_queries import bag, folder, rows  # noqa: F401


def sets(text):
    words = brute.WORD.findall(brute.lower(text))
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def likeness(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def ordered(rows):
    """Rows in the documented order; ties of ids by the hash of the text."""
    return sorted(((i, t or "", h) for i, t, h in rows), key=lambda r: (
        r[0] is None, -(r[0] or 0), r[2] & (1 << 64) - 1 if r[0] is None else r[2]))


@pytest.mark.parametrize("cell_rows", [512, 3])
def test_op13(spark, folder, monkeypatch, cell_rows):  # noqa: F811
    monkeypatch.setattr(sketches, "CELL_ROWS", cell_rows)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    source = ordered((r.doc_id, r.text, r.h) for r in table.select("doc_id", "text", F.xxhash64(
        F.coalesce("text", F.lit(""))).alias("h")).collect())
    got = collections.defaultdict(list)
    for r in sketches.op13_bottom_k(spark, folder).collect():
        got[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    assert sum(map(len, got.values())) == len(source)
    prints = {}
    for n, (i, text, _) in enumerate(source):
        following = source[(n + 1) % len(source)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[i, len(text), brute.sha(edited)].pop()
        exact = likeness(text, edited)
        small = len(sets(text) | sets(edited)) < 128
        assert r.near_edited == pytest.approx(exact, abs=1e-9 if small else 0.2)
        near = likeness(text, following)
        assert r.near_next == pytest.approx(near, abs=1e-9 if len(sets(text) | sets(following)) < 128 else 0.2)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert r.n_shingles == pytest.approx(len(sets(text)), rel=1e-9 if len(sets(text)) < 128 else 0.35)
        hashes = np.frombuffer(base64.b64decode(r.fingerprint), ">u8")
        assert len(hashes) == min(128, len(sets(text))) and (np.diff(hashes.astype(np.uint64)) > 0).all()


def test_many_texts_are_estimated_within_the_stated_error():
    rnd, errors, sketch = random.Random(6), [], sketches.Sketcher()
    for _ in range(200):
        a = [f"w{rnd.randrange(3000)}" for _ in range(800)]
        b = a[:rnd.randrange(800)] + [f"v{rnd.randrange(3000)}" for _ in range(300)]
        a, b = " ".join(a), " ".join(b)
        errors.append(sketches.alike(sketch(a), sketch(b))[0] - likeness(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_long_texts_are_sketched_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 7919}" for i in range(5000))
    whole = sketches.Sketcher()(text)
    monkeypatch.setattr(sketches, "BLOCK", 700)
    assert (sketches.Sketcher()(text) == whole).all()


def test_parts_merge_to_the_sketch_of_the_whole(spark):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(60)) for _ in range(120)] + [None, "", "one two"]
    df = spark.createDataFrame([(t, "hot" if i % 3 else f"g{i % 4}", i) for i, t in enumerate(texts)] + [
        (None, "none", 0)], "body string, `a.b` string, hash int").repartition(5)
    parts = sketches.sketched(df, "body")
    merged = {r[0]: r[1] for r in sketches.merge(parts, ["a.b"]).collect()}
    again = {r[0]: r[1] for r in sketches.merge(sketches.merge(parts, ["a.b", "hash"]), ["a.b"]).collect()}
    want = {}
    for t, g, _ in ((r.body, r["a.b"], 0) for r in df.collect()):
        want.setdefault(g, set()).update(sketches._signed(sketches.Sketcher()(t or "")).tolist())
    assert merged == again == {g: sorted(s)[:128] for g, s in want.items()}


def test_columns_agree_with_the_plain_estimates(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    pairs = [(" ".join(base[:n]), " ".join(base[m:])) for n, m in ((400, 0), (400, 100), (300, 50), (9, 3), (4, 390))]
    pairs += [("", ""), (None, "a b"), ("a b", None)]
    df = sketches.sketched(sketches.sketched(spark.createDataFrame(pairs, "a string, b string"), "a", "x"), "b", "y")
    sketch = sketches.Sketcher()
    for r in df.select("a", "b", sketches.resemblance(F.col("x"), F.col("y")).alias("j"), sketches.containment(
            F.col("x"), F.col("y")).alias("c"), sketches.distinct_shingles(F.col("x")).alias("n")).collect():
        x, y = sketch(r.a or ""), sketch(r.b or "")
        assert r.j == pytest.approx(sketches.alike(x, y)[0])
        assert r.n == pytest.approx(sketches.distinct(x), rel=1e-6)
        assert (r.c is None) == (not len(x)) and (r.c is None or 0 <= r.c <= 1)
        if r.c is not None and len(sets(r.a) | sets(r.b)) < 128:
            assert r.c == pytest.approx(len(sets(r.a) & sets(r.b)) / len(sets(r.a)))
