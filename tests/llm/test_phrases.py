"""Collocations against counts over plain lists of words."""

import collections
import random
import re

import pytest

from plumewatch.llm import phrases
from tests.llm import brute
from tests.llm.test_queries import folder, rows  # noqa: F401

CUT, WORD = re.compile("[.,;:!?\n-\r]"), re.compile("[^ \t]+")


def expected(rows, longest=3, least=10, first=2000):  # noqa: F811
    """From the definition: all counts, all cuts, all longer phrases."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in CUT.split(brute.lower(text)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i:i + size]) for i in range(len(words) - size + 1))
    held = {k: c for k, c in f.items() if c >= least and len(k) > 2}
    out = collections.defaultdict(list)
    for (lang, *words), a in held.items():
        longer = (c for (other, *w), c in held.items() if other == lang and len(w) > len(words) and any(
            w[i:i + len(words)] == words for i in range(len(w))))
        if any(100 * c >= 50 * a for c in longer):
            continue
        score, k = min((10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k)
                       for k in range(1, len(words)))
        phrase = " ".join(words)
        out[lang].append((-score, -a, phrase.encode(), (
            phrase, a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score)))
    return {(lang, i + 1, *row[3]) for lang, found in out.items()
            for i, row in enumerate(sorted(found)[:first])}


def table(seed=5, docs=160):
    rnd = random.Random(seed)
    word = ["the", "of", "Alpha", "beta", "gamma", "été", "x\x1cy", "日本", "and", "to"]
    passage = " ".join(rnd.choice(word) + str(i % 7) for i in range(60))
    out = []
    for i in range(docs):
        body = "".join(rnd.choice(word) + rnd.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r", " "])
                       for _ in range(rnd.randrange(120)))
        out.append((rnd.choice(["en", "de", None, "und"]), body + (passage if i % 3 == 0 else "")))
    return out + [("en", None), (None, ""), ("fr", "... , \n"), ("de", "the " * 3000), ("en", "of the " * 900)]


def mined(spark, data, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "`l.a` string, body string, chunk string, freq int")
    got = phrases.collocations(df.repartition(5), "body", "l.a", **how)
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}


@pytest.mark.parametrize("bits", [1 << 27, 64])
@pytest.mark.parametrize("words", [1_000_000, 50])
def test_counts_and_ranks(spark, monkeypatch, bits, words):
    """With a full map and with one in which nearly every bit is set, in large and small blocks."""
    monkeypatch.setattr(phrases, "BITS_MOST", bits)
    monkeypatch.setattr(phrases, "BITS_LEAST", 64)
    monkeypatch.setattr(phrases, "WORDS", words)
    data = table()
    assert mined(spark, data) == expected(data)


def test_longer_phrases_and_short_lists(spark):
    data = table(7, 60)
    assert mined(spark, data, longest=4, least=6, first=15) == expected(data, 4, 6, 15)


def test_awkward_rows(spark, folder, rows):  # noqa: F811
    want = expected([(lang, t) for _, t, lang, _ in rows])
    got = phrases.op12_prefix_free(spark, folder)
    assert {tuple(r) for r in got.collect()} == want
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string"] + ["bigint"] * 5


def test_chunks_own_every_word_once(spark):
    data = table(3, 40)
    df = spark.createDataFrame(data, "lang string, text string")
    parse = phrases.chunks(df).collect()
    assert sum(r.owned * r.freq for r in parse) == sum(
        len(WORD.findall(p)) for _, t in data for p in CUT.split(brute.lower(t)))
    assert all(r.owned <= len(r.chunk.split(" ")) <= r.owned + 2 for r in parse)
    assert len(parse) == len({(r.lang, r.chunk, r.owned) for r in parse})


def test_scores_past_64_bits(spark):
    """The arithmetic alone: counts of eleven digits."""
    a, l, r = 98_765_432_101, 98_765_432_109, 99_999_999_977
    got = spark.sql(f"select cast({a} as decimal(14,0)) * cast({a} as decimal(14,0)) * cast(1000000 as decimal(7,0)) "
                    f"div (cast({l} as decimal(14,0)) * cast({r} as decimal(14,0)))").first()[0]
    assert got == 10**6 * a * a // (l * r)
