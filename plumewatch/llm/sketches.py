"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the `K` smallest distinct 64-bit hashes of a text's shingles (five words, A-Z lower-cased;
a text of fewer words is one shingle), in ascending order. The k smallest hashes of a union are found from
the sketches of its parts, so sketches merge across parts, partitions and days in any order (`merge`).
Two sketches estimate resemblance, containment and the number of distinct shingles (`resemblance`,
`containment`, `distinct_shingles`); where the union has fewer than k shingles all three are exact. The
standard error of a resemblance J is sqrt(J (1 - J) / k), 0.044 at most for k = 128.

Null texts count as empty. A text without words has an empty sketch; two empty sketches resemble each other
fully, an empty and another one not at all. Very long texts are hashed in blocks of `BLOCK` shingles of
which only the smallest k are kept. Equal texts have equal sketches, so ties and repeated rows need no rule,
except in `with_successors`: there rows come in descending id order, null ids last, and equal ids by the hash
of their text. An empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, fresh, name
from plumewatch.llm.memo import Memo
from plumewatch.session import ship_package

#: Words in a shingle, and hashes in a sketch.
SHINGLE, K = 5, 128
HASH_SEED = 42
#: Words that a worker remembers, in each of two generations.
MEMO = 200_000
#: Shingles hashed at a time.
BLOCK = 1 << 20
#: Rows of a cell of the order by id, most cells, and cells of rows without an id as a power of two.
CELL_ROWS, MAX_CELLS, NULL_CELLS = 512, 16_384, 10
#: Rows of a slice.
ROWS = 1_000
TOP = np.uint64(1 << 63)


class Sketcher:
    """Makes sketches in one worker; word hashes seen before are remembered."""

    def __init__(self, k: int = K, words: int = SHINGLE):
        self.k, self.words = k, words
        self.memo = Memo(lambda w: xxhash.xxh64_intdigest(w, HASH_SEED), MEMO)
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(words)]

    def __call__(self, text: str) -> np.ndarray:
        """The smallest distinct shingle hashes, unsigned and ascending."""
        # bytes.lower and bytes.split know ASCII only, as the definition of words does
        parts = text.encode().lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        width = min(self.words, len(parts))
        best = None
        for at in range(0, len(parts) - width + 1, BLOCK):
            some = parts[at:at + BLOCK + width - 1] if at or len(parts) > BLOCK else parts
            h = np.fromiter(map(self.memo.__getitem__, some), np.uint64, len(some))
            n = len(some) - width + 1
            s = h[:n] * self.odd[0]
            for i in range(1, width):
                s += h[i:n + i] * self.odd[i]
            s = (s ^ s >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            s = (s ^ s >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            s = np.unique(s ^ s >> np.uint64(31))[:self.k]
            best = s if best is None else np.unique(np.concatenate([best, s]))[:self.k]
        return best


def alike(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, int, int]:
    """Estimated resemblance, with the shared hashes and the hashes it was read from."""
    if not len(a) and not len(b):
        return 1.0, 0, 0
    joined = np.sort(np.concatenate([a, b]))
    twice = joined[1:] == joined[:-1]
    # place of each value among the distinct ones
    place = np.cumsum(np.concatenate([[1], ~twice]))
    shared, seen = int((twice & (place[1:] <= k)).sum()), min(k, int(place[-1]))
    return shared / seen, shared, seen


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def _signed(sketch: np.ndarray) -> np.ndarray:
    """Signed numbers in the order of the unsigned ones."""
    return (sketch ^ TOP).view(np.int64)


# ---------------------------------------------------------------- sketches of columns

def sketched(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, words: int = SHINGLE) -> DataFrame:
    """`df` with the sketch of a text column as an ascending array of signed longs. One pass, no shuffle."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != out]
    # plain names inside: the Arrow step takes no dots
    plain = [f"c{i}" for i in range(len(kept))]

    def run(batches):
        sketch = Sketcher(k, words)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [_signed(sketch(t.as_py() or "")) for t in batch.column(kept.index(text))]
                ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(kept))] + [
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))],
                    names=[*plain, "made"])

    source = df.select(*[F.col(name(c)).alias(p) for c, p in zip(kept, plain)])
    made = source.mapInArrow(run, source.withColumn("made", F.array().cast("array<long>")).schema)
    return made.select(*[F.col(p).alias(c) for c, p in zip(kept, plain)], F.col("made").alias(out))


def merge(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """`keys` and the sketch of all texts of each group, from the sketches of their parts.

    Each task sends at most k hashes of a group to the one that picks the smallest, however many rows the
    group has. Groups whose parts have no shingle get an empty sketch.
    """
    hash_, place = fresh("hash"), fresh("place")
    own = [F.col(name(c)) for c in keys]
    seen = df.select(*own, F.explode_outer(name(sketch)).alias(hash_)).distinct()
    least = seen.withColumn(place, F.row_number().over(
        Window.partitionBy(*own).orderBy(F.col(hash_).asc_nulls_last()))).where(F.col(place) <= k)
    return least.groupBy(*own).agg(F.array_sort(F.collect_list(hash_)).alias(sketch))


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of both texts that they have in common."""
    both = _union(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of `a` that `b` has too; null if `a` has none."""
    j = resemblance(a, b, k)
    size = distinct_shingles(a, k)
    shared = j / (1 + j) * (size + distinct_shingles(b, k))
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / size))


# ---------------------------------------------------------------- edited texts

def _cells(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` (id, hash, text) with their cell: ranges of ids in descending order, then rows without an id."""
    count = rows.count()
    wanted = min(MAX_CELLS, math.ceil(count / CELL_ROWS))
    borders: list[float] = []
    if wanted > 1:
        found = rows.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0]
        borders = sorted({float(b) for b in found or []})
    if borders:
        cut = Bucketizer(splits=[-math.inf, *borders, math.inf], inputCol="place", outputCol="range",
                         handleInvalid="keep")
        rows = cut.transform(rows.withColumn("place", F.col("id").cast("double")))
        number = F.lit(len(borders)) - F.col("range").cast("int")
    else:
        number = F.lit(0)
    absent = F.shiftrightunsigned("hash", 64 - NULL_CELLS).cast("int") + F.lit(len(borders) + 1)
    return rows.select(F.when(F.col("id").isNull(), absent).otherwise(number).alias("cell"), "id", "hash", "text"), \
        len(borders) + 1 + (1 << NULL_CELLS)


def with_successors(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """cell, guest, id and text: every row, so sorted that the next row of a cell is its successor.

    Rows come in descending id order and the last is followed by the first. They are dealt to ranges of
    ids, one shuffle of the texts; the first row of each cell goes to the cell before it as well, as a guest
    that ends it. There are at most `MAX_CELLS` + 2^`NULL_CELLS` cells, and so many guests, whose ids are
    broadcast.
    """
    spark = df.sparkSession
    content = F.coalesce(F.col(name(text)), F.lit(""))
    rows, most = _cells(df.select(F.col(name(row_id)).cast("long").alias("id"), F.xxhash64(content).alias("hash"),
                                  content.alias("text")))
    # ascending in the order of the rows
    head = F.struct(F.bitwise_not("id").alias("turned"), "hash")
    firsts = sorted((r.cell, r.head.turned, r.head.hash) for r in rows.groupBy("cell").agg(
        F.min(head).alias("head")).collect()) if most else []
    guests = spark.createDataFrame(
        [(None if t is None else ~t, h, firsts[i - 1][0]) for i, (_, t, h) in enumerate(firsts)],
        "g_id long, g_hash long, before int")
    placed = rows.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("g_id")) & (
        F.col("hash") == F.col("g_hash")), "left")
    own = F.struct(F.col("cell"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("before").alias("cell"), F.lit(1).alias("guest"))
    dealt = placed.select(F.explode_outer(F.when(F.col("before").isNull(), F.array(own)).otherwise(
        F.array(own, visit))).alias("at"), "id", "hash", "text").select("at.cell", "at.guest", "id", "hash", "text")
    return dealt.repartition("cell").sortWithinPartitions(
        "cell", "guest", F.col("id").desc_nulls_last(), "hash", "text").select("cell", "guest", "id", "text")


def _pairs(batches) -> Iterator[tuple[int | None, str, str]]:
    """id, text and the next text of every row."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for cell, guest, key, text in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                if held is not None and held[0] == cell:
                    yield held[1], held[2], text
                held = None if guest else (cell, key, text)


FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double, n_shingles double, held_by_edited double")


def fingerprints(df: DataFrame, text: str = "text", row_id: str = "doc_id", k: int = K,
                 words: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited text, with the likeness of both and that to the next text.

    The edited text has the last half of the code points replaced by the first as many of the next
    document. Fingerprints are the hashes of a sketch, big-endian, in base64. `n_shingles` and
    `held_by_edited` are the estimated number of distinct shingles and the share of them in the edited text.
    """
    ship_package(df.sparkSession)

    def run(batches):
        sketch = Sketcher(k, words)
        names = [f.split()[0] for f in FINGERPRINTS.split(", ")]
        out, after = [], None

        def coded(hashes):
            return base64.b64encode(hashes.astype(">u8").tobytes()).decode()

        for key, own, following in _pairs(batches):
            # the sketch of the row before's successor is this row's own
            mine = after[1] if after is not None and after[0] == own else sketch(own)
            after = (following, sketch(following))
            half = len(own) // 2
            edited = own[:len(own) - half] + following[:half]
            changed = sketch(edited)
            near, _, _ = alike(mine, changed, k)
            size = distinct(mine, k)
            inside = min(1.0, near / (1 + near) * (size + distinct(changed, k)) / size) if size else None
            out.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), coded(mine), coded(changed),
                        near, alike(mine, after[1], k)[0], size, inside))
            if len(out) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=names)

    return with_successors(df, text, row_id).mapInArrow(run, FINGERPRINTS)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
