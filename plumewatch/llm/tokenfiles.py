"""Token-id files with Elias-Fano document boundaries.

A set of files is a Parquet folder, written and committed by Spark, so a lost executor leaves no torn
file and any store that Spark reaches will do. Each row is a block:

    shard, block      place in the order of documents
    base              ids in the shard before this block
    ids, width        concatenated ids, little-endian unsigned, 2 or 4 bytes each
    documents, total  counts of the block
    low, low_bits     lower bits of the document ends, packed
    high              upper bits in unary: for each end a set bit after as many zeros as its upper
                      part has grown
    select            place in `high` of every 64th set bit, unsigned 32-bit
    doc_id            ids of the documents

The ends are those of Elias and Fano: 2 + log2(ids / documents) bits for each document, and no 64-bit
table. Ends are found with the select samples, those of a few documents (`lookup`) as those of all.

The content of a special token in a text gives its id, as the library does by default.

Null texts count as empty: such a document has its end id only. Documents are in ascending id order, null
ids first, repeated ids next to each other in any order. A document is never cut, so a very long one makes
a block of its own. An empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, name
from plumewatch.llm.memo import Odd, whole
from plumewatch.llm.pieces import Words, gather, slices
from plumewatch.session import scratch_path, ship_package

#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 20
#: Set bits between two samples of the select structure.
SAMPLE = 64
#: Words that a worker remembers, in each of two generations, and the longest of them.
MEMO, LONGEST = 300_000, 64
#: Words encoded together, and those of them in one text.
TOGETHER, RUN = 20_000, 500
#: Tokenizer files have a few MB.
MAX_TOKENIZER_BYTES = 64_000_000
SIGNS = ".,;:!?"

if sys.byteorder != "little":
    raise ImportError("token files are packed on little-endian machines")

BLOCKS = ("shard int, block int, base long, ids binary, width int, documents int, total long, low binary, "
          "low_bits int, high binary, select binary, doc_id array<long>")


class EliasFano:
    """A non-decreasing sequence of whole numbers."""

    def __init__(self, low: bytes, low_bits: int, high: bytes, select: bytes, count: int):
        self.low_bits, self.count = low_bits, count
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.select = np.frombuffer(select, "<u4")

    @staticmethod
    def pack(values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(bits)) & 1 if bits else np.zeros((n, 0), np.int64)
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little")
        return EliasFano(low.tobytes(), bits, high.tobytes(), ones[::SAMPLE].astype("<u4").tobytes(), n)

    def parts(self) -> tuple[bytes, int, bytes, bytes]:
        return self.low.tobytes(), self.low_bits, self.high.tobytes(), self.select.tobytes()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return int(self.at(np.array([i]))[0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at some places: from the nearest sample on, whole bytes are skipped by their set bits."""
        bit = self.select[places // SAMPLE].astype(np.int64)
        byte, left = bit >> 3, places % SAMPLE
        value = self.high[byte] >> (bit & 7).astype(np.uint8) << (bit & 7).astype(np.uint8)
        while True:
            held = np.bitwise_count(value)
            on = np.flatnonzero(left >= held)
            if not len(on):
                break
            left[on] -= held[on]
            byte[on] += 1
            value[on] = self.high[byte[on]]
        for step in range(7):
            value = np.where(left > step, value & (value - np.uint8(1)), value)
        first = value & (~value + np.uint8(1))
        out = (byte * 8 + np.bitwise_count(first - np.uint8(1)) - places) << self.low_bits
        for j in range(self.low_bits):
            b = places * self.low_bits + j
            out |= (self.low[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(np.int64) << j
        return out


class Tokens:
    """Encodes with the tokenizers library in one worker; words seen before are remembered.

    Texts are cut where the library's pattern always cuts, every distinct word of a slice is looked up once,
    and the ids are gathered for the whole slice. Texts with other white space at those places, and texts that
    hold the content of an added token, such as a special one, go to the library whole.
    """

    def __init__(self, data: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.source = data
        self.tokenizer = Tokenizer.from_str(data)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo, self.older = {}, {}
        # one sign after a word is always a piece of its own
        self.signs = dict(zip(SIGNS, self._many(list(SIGNS))))
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(space)

    def _many(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(
            texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Words behind a space each: many at a time as one text, cut where a token opens with the space.

        Words behind a line feed have no such token and are encoded one by one, at the end.
        """
        lines = len(words)
        while lines and words[lines - 1][0] == "\n":
            lines -= 1
        runs = [words[i:min(i + RUN, lines)] for i in range(0, lines, RUN)]
        out = []
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(
                ["".join(map(whole, run)) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(run):
                raise ValueError("this tokenizer does not open a token at each single space")
            raw, cuts = ids.tobytes(), (at * self.width).tolist()
            out += [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)])]
        return out + self._many([whole(w) for w in words[lines:]])

    def _known(self, words: list[str], later: list[bool]) -> list[bytes | None]:
        """The ids of the words of a slice that stand behind a space; None for those that cannot stand alone."""
        out: list[bytes | None] = [None] * len(words)
        new: dict[str, list[tuple[int, bytes]]] = {}
        memo, older, signs = self.memo, self.older, self.signs
        for i, w in enumerate(words):
            if not later[i]:
                continue
            sign = signs.get(w[-1:], b"")
            if sign:
                if w[:-1].isalpha():
                    w = w[:-1]
                else:
                    sign = b""
            ids = memo.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is None:
                    new.setdefault(w, []).append((i, sign))
                    continue
                memo[w] = ids
            out[i] = ids + sign
        fine = []
        for w in new:
            try:
                whole(w)
                fine.append(w)
            except Odd:
                continue
        fine.sort(key=lambda w: w[0] == "\n")
        for at in range(0, len(fine), TOGETHER):
            some = fine[at:at + TOGETHER]
            for w, ids in zip(some, self._encoded(some)):
                for i, sign in new[w]:
                    out[i] = ids + sign
                if len(w) <= LONGEST:
                    memo[w] = ids
            if len(memo) >= MEMO:
                self.older, self.memo = memo, {}
                memo = self.memo
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        cut = Words(texts, lines=True)
        count, known = len(texts), len(cut.words)
        special = np.zeros(count, bool)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        later = np.zeros(known, bool)
        places = np.ones(len(cut.index), bool)
        places[cut.firsts] = False
        later[cut.index[places]] = True
        blobs = self._known(cut.words, later.tolist())
        odd = cut.holding(np.fromiter((b is None for b in blobs), bool, known), but_first=True) | special
        # what stands before the first cut is no word after a space; it is encoded as it is
        alone = np.diff(cut.offsets) == 1
        heads = [cut.words[i] for i in cut.index[cut.firsts].tolist()]
        odd |= np.fromiter((h[-1:].isspace() for h in heads), bool, count) & ~alone
        for i in np.flatnonzero(odd).tolist():
            heads[i] = texts[i].as_py()
        blobs = [b or b"" for b in blobs] + self._many(heads)
        order = cut.index.copy()
        order[cut.firsts] = known + np.arange(count)
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.width
        counts = lengths[order]
        counts[np.repeat(odd, np.diff(cut.offsets)) & places] = 0
        flat = gather(np.frombuffer(b"".join(blobs), self.kind), lengths, order, counts)
        return flat, np.add.reduceat(counts, cut.firsts) if count else counts


_tokens: dict[int, Tokens] = {}


def _tokenizer(shared) -> Tokens:
    if 0 not in _tokens or _tokens[0].source != shared.value:
        _tokens[0] = Tokens(shared.value)
    return _tokens[0]


def write(df: DataFrame, tokenizer: str, path: str, text: str = "text", row_id: str = "doc_id",
          end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encodes all texts, appends `end_id` to each, and writes the files in ascending id order.

    The texts are shuffled once, by range of the ids, and each task writes the blocks of its range while
    it reads; it holds one block.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as file:
        data = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError("this tokenizer file is too large to send to the workers")
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        tokens = _tokenizer(shared)
        shard, block, base = TaskContext.get().partitionId(), 0, 0
        ids, runs, size = [], [], 0

        def close():
            nonlocal block, base, ids, runs, size
            ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
            low, low_bits, high, select = EliasFano.pack(ends).parts()
            row = {
                "shard": shard, "block": block, "base": base, "ids": np.concatenate(runs).tobytes(),
                "width": tokens.width, "documents": len(ids), "total": int(ends[-1]), "low": low,
                "low_bits": low_bits, "high": high, "select": select, "doc_id": ids}
            block, base = block + 1, base + int(ends[-1])
            ids, runs, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_block_schema())

        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = tokens.encode(part.column(1))
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                for key, i, j in zip(part.column(0).to_pylist(), (ends - counts - 1).tolist(), ends.tolist()):
                    if ids and size + j - i > block_ids:
                        yield close()
                    ids.append(key)
                    runs.append(flat[i:j])
                    size += j - i
        if ids:
            yield close()

    df.select(F.col(name(row_id)).cast("long").alias("doc_id"), F.col(name(text)).alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCKS) \
        .write.parquet(path)


def _block_schema() -> pa.Schema:
    return pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("ids", pa.binary()),
        ("width", pa.int32()), ("documents", pa.int32()), ("total", pa.int64()), ("low", pa.binary()),
        ("low_bits", pa.int32()), ("high", pa.binary()), ("select", pa.binary()),
        ("doc_id", pa.list_(pa.int64()))])


def _starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row for each task that wrote."""
    return blocks.groupBy("shard").agg(F.sum("total").alias("ids_total")).select(
        F.col("shard").alias("s_shard"),
        (F.sum("ids_total").over(Window.orderBy("shard")) - F.col("ids_total")).alias("shard_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (array) of every document."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, begins, ends = _opened(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_id"], pa.int64()),
                    pa.array(begins + row["base"]), _runs(ids, begins, ends)],
                    names=["shard", "doc_id", "inner", "ids"])

    rows = blocks.mapInArrow(run, "shard int, doc_id long, inner long, ids array<int>")
    return _placed(rows, blocks)


def lookup(spark: SparkSession, path: str, wanted: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """doc_id, start and ids of the wanted documents only; ids that the files lack give no row.

    The places of the wanted documents come from the id lists alone. Only their blocks are opened, and of
    those only the ends asked for, by select.
    """
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ids = wanted.select(F.col(name(row_id)).cast("long").alias("w_id")).distinct()
    found = blocks.select("shard", "block", F.posexplode("doc_id").alias("place", "id")).join(
        ids, F.col("id").eqNullSafe(F.col("w_id"))).groupBy("shard", "block").agg(
        F.sort_array(F.collect_list("place")).alias("places"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places = np.array(row["places"], np.int64)
                ids, begins, ends = _opened(row, places)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(places), pa.int32()),
                    pa.array([row["doc_id"][i] for i in row["places"]], pa.int64()),
                    pa.array(begins + row["base"]), _runs(ids, begins, ends)],
                    names=["shard", "doc_id", "inner", "ids"])

    rows = blocks.join(found, ["shard", "block"]).mapInArrow(
        run, "shard int, doc_id long, inner long, ids array<int>")
    return _placed(rows, blocks)


def _opened(row: dict, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block, with begins and ends of the documents at some places, or of all."""
    ends = EliasFano(row["low"], row["low_bits"], row["high"], row["select"], row["documents"])
    places = np.arange(row["documents"]) if places is None else places
    begins = np.where(places > 0, ends.at(np.maximum(places - 1, 0)), 0)
    return np.frombuffer(row["ids"], f"<u{row['width']}"), begins, ends.at(places)


def _runs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    lengths = ends - begins
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(
        ids[np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(lengths.sum())].astype(np.int32)))


def _placed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    # the broadcast side has a row for each task of the writing job
    return rows.join(F.broadcast(_starts(blocks.select("shard", "total"))),
                     F.col("shard") == F.col("s_shard")).withColumn(
        "start", F.col("inner") + F.col("shard_start")).drop("shard", "s_shard", "shard_start", "inner")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, begins, ends = _opened(row)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_id"], pa.int64()),
                    pa.array(begins + row["base"]), pa.array(ends - begins), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(
        run, "shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return _placed(rows, blocks)


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write(documents(spark, sf_dir).select("doc_id", "text"),
          public_tokenizers.path("byte_bpe_50k.json"), path)
    return checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
