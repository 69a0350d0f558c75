"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are read as Latin-1 characters so that an Aho-Corasick automaton of the vocabulary can find the
longest token at a place. A token may follow another one only if the merges of the vocabulary would
keep exactly that border; this test of a pair is remembered. Where no token fits, the encoder takes back
its last token and tries the next shorter one, and marks the place as dead, so that the work is linear
in the piece. Results equal those of the merges themselves.

Null texts count as empty and give no ids. Rows are handled alone: ties, repeated rows and other
columns play no part, an empty table gives an empty table. Texts of any length are processed whole;
what a worker remembers is bounded by `MEMO` pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewatch.llm.frames import documents, name
from plumewatch.llm.memo import Memo, Odd, cut, whole
from plumewatch.session import ship_package

#: Pieces that a worker remembers, in each of two generations.
MEMO = 200_000
#: Tested pairs of tokens that a worker remembers, and rows encoded at a time.
PAIRS, ROWS = 400_000, 1000
#: A rank file is a few MB at most; a larger one is no vocabulary.
MAX_VOCABULARY_BYTES = 64_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number on each line)."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("this rank file is too large to send to the workers")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_parts(ranks: dict[bytes, int], piece: bytes, below: int) -> list[bytes]:
    """Plain merging of a short piece with the tokens under a rank."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], below)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks with the two halves each token is merged from."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        #: Halves; a single byte is its own half, an unreachable token has -1.
        self.left, self.right = array("q", [-1]) * size, array("q", [-1]) * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) == 1:
                self.left[rank] = self.right[rank] = rank
                continue
            parts = merge_parts(ranks, token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")


class Encoder:
    """Encodes and decodes in one worker."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.vocabulary = vocabulary
        v = vocabulary
        self.tokens, self.left, self.right = v.tokens, v.left, v.right
        self.packed = [int(i).to_bytes(4, "little") for i in range(len(v.tokens))]
        self.split = regex.compile(v.pattern).findall
        self.ids = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in v.ranks.items():
            latin = token.decode("latin-1")
            self.ids[latin] = rank
            if v.left[rank] >= 0:
                self.automaton.add_word(latin, rank)
        self.automaton.make_automaton()
        #: The next shorter token that a token starts with; -1 ends the list.
        self.shorter = array("q", [-1]) * len(v.tokens)
        for token, rank in v.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                found = v.ranks.get(token[:n], -1)
                if found >= 0 and v.left[found] >= 0:
                    self.shorter[rank] = found
                    break
        self.longest, self.size = self.automaton.iter_long, len(v.tokens)
        self.lengths = [len(t) for t in v.tokens]
        self.shorter = self.shorter.tolist()
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo(self._piece, memo // 3)
        self.chunks = Memo(self._chunk, memo)
        self.firsts = Memo(self._plain, memo // 10)
        # a single sign after a word is a piece of its own, whatever follows
        self.signs = {c: self._piece(c) for c in ".,;:!?"}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between two neighbouring tokens.

        Both tokens are taken apart again, latest merge first. If at any time the halves at the border
        form a token that is merged before the merge just undone, the border would have vanished.
        """
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        good = self.pairs[a * self.size + b] = self._fits(a, b)
        return good

    def _fits(self, a: int, b: int) -> bool:
        tokens, ranks = self.tokens, self.vocabulary.ranks
        bound = 1 << 62
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < bound and self.left[joined] == a and \
                    self.right[joined] == b:
                return False
            a_single, b_single = len(tokens[a]) == 1, len(tokens[b]) == 1
            if a_single and b_single:
                return True
            if b_single or (not a_single and a > b):
                bound, a = a, self.right[a]
            else:
                # a merge of the same rank further left comes first
                bound, b = b + 1, self.left[b]

    def backtrack(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters."""
        longest, shorter, lengths, size = self.longest, self.shorter, self.lengths, self.size
        known = self.pairs.get
        n, at, last, out = len(text), 0, -1, []
        dead = set()
        token = next(longest(text))[1]
        while True:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead:
                    if last < 0:
                        break
                    good = known(last * size + token)
                    if good is None:
                        good = self.fits(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                token = next(longest(text, at))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        latin = piece.encode().decode("latin-1")
        known = self.ids.get(latin)
        if known is not None:
            return self.packed[known]
        return b"".join([self.packed[i] for i in self.backtrack(latin)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _chunk(self, key: str) -> bytes:
        """A later piece of `cut`. Words alone and words before one sign need no pattern."""
        if key.isalpha():
            return self._piece(" " + key)
        if key[:-1].isalpha() and key[-1] in self.signs:
            return self.chunks[key[:-1]] + self.signs[key[-1]]
        return self._plain(whole(key))

    def forget(self) -> None:
        """Gives back what was remembered; idle workers would hold it through later stages."""
        for memo in (self.pieces, self.chunks, self.firsts):
            memo.clear()
            memo.older = {}
        self.pairs.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        try:
            first, rest = cut(text)
            return self.firsts[first] + b"".join(map(self.chunks.__getitem__, rest))
        except Odd:
            return self._plain(text)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Vocabulary:
    """Rank file and halves, read where the query is planned."""
    return Vocabulary(read_ranks(path), pattern)


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary."""
    if shared.value is not (known := _encoders.get(0)) and (
            known is None or known.vocabulary is not shared.value):
        _encoders[0] = Encoder(shared.value)
    return _encoders[0]


def _apply(df: DataFrame, function, out: list[T.StructField]) -> DataFrame:
    """Adds columns made from Arrow batches; columns of the same name are replaced."""
    ship_package(df.sparkSession)
    added = {f.name for f in out}
    kept = [f for f in df.schema.fields if f.name not in added]
    return df.mapInArrow(function, T.StructType(kept + out))


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.names.index(n)) for n in names] + list(added.values()),
        names=names + list(added))


def _small(batches):
    """Slices of the batches, so that a worker holds the results of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 32-bit) and, if named, the bytes they decode to.

    One pass, no shuffle. The vocabulary travels to the workers once; its size is checked.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path, pattern))

    def run(batches):
        encoder = _encoder(shared)
        for batch in _small(batches):
            texts = batch.column(batch.schema.names.index(text))
            blobs = [encoder.encode(t.as_py()) for t in texts]
            added = {ids: pa.array(blobs, pa.binary())}
            if decoded:
                added[decoded] = pa.array([encoder.decode(b) for b in blobs], pa.binary())
            yield _with(batch, added)
        encoder.forget()

    fields = [T.StructField(ids, T.BinaryType())]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return _apply(df, run, fields)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of packed ids; bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(load(path, pattern))

    def run(batches):
        encoder = _encoder(shared)
        for batch in _small(batches):
            blobs = batch.column(batch.schema.names.index(ids))
            yield _with(batch, {out: pa.array(
                [encoder.decode(b.as_py()).decode("utf-8", "replace") for b in blobs], pa.string())})

    return _apply(df, run, [T.StructField(out, T.StringType())])


def digest(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", F.col(name("text")))
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                 decoded="decoded")
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
