"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked id pairs.

Both tokenizers read a space and the text. The ends of their tokens, as byte offsets, are keys of an
end-to-index dictionary for each side; the sorted keys that both have slice the two id lists into groups, and
the links of a group are the pairs whose byte ranges overlap (`aligned`).

Both tokenizers start a token at a space that stands alone before other characters, so such a space is a
common end and each word is aligned by itself, once for each distinct word that a worker remembers. Texts
with other white space at those places, or with words whose tokens do not give back their bytes, are aligned
whole.

A text that is null or empty, or whose tokens do not join to the text, has no tokens: its counts are zero and
its digest is empty. Special tokens in texts are plain text. Very long texts are handled like others; a task
holds one slice. Repeated rows count as documents of their own. Null ids are kept, ties of a pair's count are
all best. An empty table gives an empty table; other columns may have any names.

The count of an id pair is the number of documents that hold it. Counts have a row for each pair of ids that
occurs, at most the product of both vocabularies. They are broadcast up to `BROADCAST` rows, counted first;
beyond that, documents' pairs are shuffled to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, name, store
from plumewatch.llm.memo import Memo
from plumewatch.llm.pieces import Words, gather, slices
from plumewatch.session import ship_package

#: Words that a worker remembers, in each of two generations, and the longest of them.
MEMO, LONGEST = 120_000, 64
#: Words encoded together.
TOGETHER = 20_000
#: Most pair counts that are broadcast; 24 bytes each.
BROADCAST = 2_000_000
MAX_FILE_BYTES = 64_000_000
SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, the bytes of each id and its decimal digits."""

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _table(self, tokens: list[bytes]) -> None:
        self.bytes = tokens


class ByteLevel(Side):
    """A tokenizer file of the tokenizers library with a byte-level alphabet; reads a space before the text."""

    def __init__(self, data: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_level()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self._table([added[i].encode() if i in added else bytes(alphabet[c] for c in vocabulary.get(i, ""))
                     for i in range(max(vocabulary) + 1)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Piecewise(Side):
    """A sentencepiece model with byte fallback; it adds the space itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        model = self.model = SentencePieceProcessor(model_proto=data)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self._table([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
                     for i, p in enumerate(pieces)])
        # a token never reaches over a space behind another character if no piece holds one there
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def aligned(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes],
            ) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """Groups between common ends, and all pairs of ids whose byte ranges overlap."""
    def ends(ids, table):
        out, at = {}, 0
        for i, token in enumerate(ids):
            at += len(table[token])
            out[at] = i + 1
        return out

    ends_a, ends_b = ends(a, a_bytes), ends(b, b_bytes)
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        to_i, to_j = ends_a[end], ends_b[end]
        left, right = a[i:to_i], b[j:to_j]
        groups.append((left, right))
        if len(left) == 1 or len(right) == 1:
            links += [(x, y) for x in left for y in right]
        else:
            # walk both sides: the token that ends first is left behind
            x = y = 0
            end_x, end_y = len(a_bytes[left[0]]), len(b_bytes[right[0]])
            while True:
                links.append((left[x], right[y]))
                if end_x == end_y:
                    break
                if end_x < end_y:
                    x += 1
                    end_x += len(a_bytes[left[x]])
                else:
                    y += 1
                    end_y += len(b_bytes[right[y]])
        i, j = to_i, to_j
    return groups, links


def _digest_text(groups) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


class Aligner:
    """Aligns slices of texts in one worker."""

    def __init__(self, first: bytes, second: bytes):
        self.a, self.b = ByteLevel(first), Piecewise(second)
        self.memo = Memo(lambda w: self._words([w])[0], MEMO, LONGEST)

    def _one(self, text: str, a: list[int], b: list[int]):
        """Digest text, packed links, tokens of both sides and groups; None if the bytes differ."""
        want = b" " + text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return None
        groups, links = aligned(a, b, self.a.bytes, self.b.bytes)
        packed = np.array([x << 32 | y for x, y in links], np.int64).tobytes()
        return _digest_text(groups).encode(), packed, len(a), len(b), len(groups)

    def _words(self, words: list[str]) -> list:
        return [self._one(w, a, b) for w, a, b in zip(words, self.a.ids(words), self.b.ids(words))]

    def _known(self, words: list[str]) -> list:
        """What each distinct word of a slice yields; None for words that cannot stand alone."""
        out: list = [None] * len(words)
        new = []
        for i, w in enumerate(words):
            # no white space at its ends, which the tokenizers could join with the space beside it
            if not w or w[0].isspace() or w[-1].isspace() or SPACE in w:
                continue
            found = self.memo.get(w)
            if found is None and (found := self.memo.older.get(w)) is not None:
                self.memo.put(w, found)
            out[i] = found
            if found is None:
                new.append(i)
        for at in range(0, len(new), TOGETHER):
            some = new[at:at + TOGETHER]
            for i, found in zip(some, self._words([words[i] for i in some])):
                out[i] = found
                if found is not None and len(words[i]) <= LONGEST:
                    self.memo.put(words[i], found)
        return out

    def slice(self, texts: pa.Array):
        """Counts (rows of n_a, n_b, n_groups), digests, and the links of each text with their offsets."""
        cut = Words(texts)
        known = self._known(cut.words) if self.b.splits else [None] * len(cut.words)
        whole = cut.holding(np.fromiter((k is None for k in known), bool, len(known)))
        lengths = np.fromiter((len(k[1]) // 8 if k else 0 for k in known), np.int64, len(known))
        flat = np.frombuffer(b"".join(k[1] for k in known if k), np.int64)
        shares = np.array([k[2:] if k else (0, 0, 0) for k in known], np.int64).reshape(-1, 3)
        counts = np.add.reduceat(shares[cut.index], cut.firsts, axis=0)
        links = gather(flat, lengths, cut.index)
        ends = np.concatenate([[0], np.cumsum(lengths[cut.index])])[cut.offsets]
        digests, parts = [], []
        names = [k[0] if k else b"" for k in known]
        for t in range(len(texts)):
            if not whole[t]:
                digests.append(hashlib.sha256(b";".join(
                    map(names.__getitem__, cut.index[cut.offsets[t]:cut.offsets[t + 1]].tolist()))).hexdigest())
                parts.append(links[ends[t]:ends[t + 1]])
                continue
            text = texts[t].as_py() or ""
            found = self._words([text])[0] if text else None
            counts[t] = found[2:] if found else (0, 0, 0)
            digests.append(hashlib.sha256(found[0]).hexdigest() if found else "")
            parts.append(np.frombuffer(found[1] if found else b"", np.int64))
        return counts, digests, parts


_aligners: dict[tuple[bytes, bytes], Aligner] = {}


def _aligner(first: bytes, second: bytes) -> Aligner:
    key = (hashlib.md5(first).digest(), hashlib.md5(second).digest())
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(first, second)
    return _aligners[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError("this tokenizer file is too large to send to the workers")
    return data


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


def alignments(df: DataFrame, first: str, second: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Token and group counts, digest and the distinct linked pairs (a << 32 | b) of every text, with how often."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((_file(first), _file(second)))
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        aligner = _aligner(*shared.value)
        for whole in batches:
            for batch in slices(whole, 1):
                counts, digests, parts = aligner.slice(batch.column(1))
                found = [np.unique(p, return_counts=True) for p in parts]
                offsets = pa.array(np.cumsum([0] + [len(p) for p, _ in found]).astype(np.int32))
                flat = np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(counts[:, i]) for i in range(3)),
                     pa.array([len(p) for p in parts], pa.int64()), pa.array(digests, pa.string()),
                     *(pa.ListArray.from_arrays(offsets, pa.array(f)) for f in flat)], names=names)

    return df.select(F.col(name(row_id)).cast("long").alias("doc_id"), F.col(name(text)).alias("text")).mapInArrow(
        run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, `count` (documents that hold it) and whether no pair of the same first id has more."""
    counts, _ = store(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("count")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def linked(df: DataFrame, first: str, second: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row for each text: token, group and link counts, and how its links stand in the whole corpus.

    The alignments are written once. Pairs are summed up by document inside the task that reads it if the
    counts are broadcast.
    """
    rows, _ = store(alignments(df, first, second, text, row_id).withColumn(
        "rid", F.monotonically_increasing_id()), "alignments")
    counts, _ = store(pair_counts(rows), "pair-ranks")
    known = counts.count()
    held = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "rid", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = held.join(F.broadcast(counts) if known <= BROADCAST else counts, "pair").groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op11_common_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return linked(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model"))
