"""Alignment of two tokenizers against a plain version over whole texts."""

import collections
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumewatch.llm import alignment
from tests.llm import brute
from tests.llm.test_queries import bag, folder, rows  # noqa: F401

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
        self.a.encode_special_tokens = True
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {chr(b): b for b in kept}
        for b in range(256):
            if b not in kept:
                self.alphabet[chr(256 + len(self.alphabet) - len(kept))] = b

    def tokens(self, text):
        """Spans (id, start, stop) of both sides, or None."""
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i)))
             for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
              else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        if not text or any(b"".join(t for _, t in s) != b" " + text.encode() for s in (a, b)):
            return None
        out = []
        for side in (a, b):
            at, spans = 0, []
            for i, t in side:
                spans.append((i, at, at + len(t)))
                at += len(t)
            out.append(spans)
        return out

    def align(self, text):
        """n_a, n_b, n_groups, digest and all links."""
        found = self.tokens(text or "")
        if found is None:
            return 0, 0, 0, "", []
        a, b = found
        groups, cuts = [], {e for *_, e in a} & {e for *_, e in b}
        texts = []
        for side in (a, b):
            # token ids joined by commas, a semicolon behind every common end
            texts.append("".join(f"{i}{';' if e in cuts else ','}" for i, _, e in side)[:-1].split(";"))
        groups = ["|".join(pair) for pair in zip(*texts, strict=True)]
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return len(a), len(b), len(groups), brute.sha(";".join(groups)), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, rows):  # noqa: F811
    memo = {t: plain.align(t) for _, t, *_ in rows}
    count = collections.Counter(p for _, t, *_ in rows for p in set(memo[t][4]))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, t, *_ in rows:
        n_a, n_b, n_groups, digest, links = memo[t]
        out.append((i, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), digest))
    return out


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_op11(spark, folder, rows, plain, monkeypatch, broadcast):  # noqa: F811
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    got = alignment.op11_common_ends(spark, folder)
    assert bag(tuple(r) for r in got.collect()) == bag(expected(plain, rows))


def test_random_texts(plain):
    aligner = alignment._aligner(alignment._file(FILES[0]), alignment._file(FILES[1]))
    assert aligner.b.splits
    rnd = random.Random(8)
    import pyarrow as pa

    texts = [None, "", " ", "▁a", "a ▁b", "ﬁ x", "é é", "x 　y", "<0x41> <s>"] + [
        "".join(rnd.choice(["ab", "ing", "the", " ", " ", " ", "\n", "\t", ".", "é", "日本", "😀", "'s", "  ", "01",
                            " ", "\x00", "ß", "\x1c", "<|endoftext|>"]) for _ in range(rnd.randrange(1, 40)))
        for _ in range(1500)]
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        counts, digests, parts = aligner.slice(pa.array(some, pa.string()))
        for t, n, d, p in zip(some, counts.tolist(), digests, parts):
            want = plain.align(t)
            assert (*n, d) == want[:4], t
            assert [(x >> 32, x & 0xFFFFFFFF) for x in p.tolist()] == want[4]


def test_several_tokens_on_both_sides():
    a_bytes, b_bytes = [b"abc", b"de", b"f"], [b"a", b"bcd", b"ef"]
    groups, links = alignment.aligned([0, 1, 2], [0, 1, 2], a_bytes, b_bytes)
    assert groups == [([0, 1, 2], [0, 1, 2])] and links == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
