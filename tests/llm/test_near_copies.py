"""Near copies by whole-text similarity: planted pairs, chains and large groups."""

import numpy as np
import pytest

from plumewatch.llm import simhash
from tests.llm import brute


def sets(text):
    parts = text.lower().split()
    k = min(5, len(parts))
    return {tuple(parts[i:i + k]) for i in range(len(parts) - k + 1)}


def similarity(a, b):
    return len(sets(a) & sets(b)) / len(sets(a) | sets(b))


def planted(rng, share, words=220):
    """Two texts whose five-word similarity is close to `share`: the second one has another end."""
    common = round((words - 4) * 2 * share / (1 + share)) + 4
    text = [f"w{x}" for x in rng.integers(0, 5000, words)]
    return " ".join(text), " ".join(text[:common] + [f"v{x}" for x in rng.integers(0, 5000, words - common)])


def expected(texts):
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    return set(brute.smallest(list(range(len(texts))), brute.roots(len(texts), pairs)))


def kept(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in simhash.dedup(frame).collect()}


def test_planted_pairs(spark):
    rng = np.random.default_rng(3)
    shares = [s for s in (0.5, 0.6, 0.7, 0.78, 0.82, 0.85, 0.9, 0.95) for _ in range(25)]
    texts = [t for s in shares for t in planted(rng, s)]
    near = {2 * i for i in range(len(shares)) if similarity(texts[2 * i], texts[2 * i + 1]) >= 0.8}
    assert len(near) == 100
    assert kept(spark, texts) == set(range(len(texts))) - {i + 1 for i in near}


@pytest.mark.parametrize("size", (256, 12))
def test_groups_larger_than_a_task(spark, monkeypatch, size):
    """A dense group, a chain and looser relatives, in one task and in chunks."""
    monkeypatch.setattr(simhash, "TEXTS", size)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for start in range(0, 120, 6):  # neighbours are similar, the ends are not
        texts.append(" ".join(base[start:] + [f"x{start}-{i}" for i in range(4)]))
    for i in range(40):
        own = list(base)
        own[int(rng.integers(0, 200))] = f"y{i}"
        texts.append(" ".join(own))
    for i in range(20):
        texts.append(" ".join(base[:150] + [f"z{i}-{j}" for j in range(50)]))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    assert kept(spark, texts) == expected(texts)
