"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), split at signs and line ends into pieces and those into words. Every piece is cut
into chunks where the content says so: a chunk starts where the hash of two neighbouring words is divisible by
`MODULUS`, so equal passages give equal chunks wherever they stand. Chunks overlap: each one carries the words
behind it that a phrase of its last word needs. The distinct chunks with their frequencies are the dictionary of
the parse; passages that many documents share are in it once.

Phrases are counted inside the distinct chunks, weighted by their frequency. A phrase belongs to the chunk that
owns its first word, so what lies in an overlap is counted once. A first pass sums two-word phrases by a 64-bit
hash. Hashes with enough occurrences set bits in a map of bounded size, which goes to all tasks. A second pass
then sums phrases by their words: single words, two-word phrases whose bit is set, and longer ones all of whose
two-word parts are. A bit set by another phrase lets too many through and none is lost, so all counts are exact
whatever the size of the map; a full map only costs a larger shuffle.

Everything is per language, null counting as `und`. Null and empty texts have no words. Very long texts make a slice of
their own. Repeated rows count again. Ties in score and frequency go by the phrase in UTF-8
byte order. An empty table gives an empty table; other columns may have any names. A task holds one slice of
texts and a block of about `WORDS` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import UPPER, documents, name, store
from plumewatch.llm.pieces import Words, slices
from plumewatch.session import ship_package

#: Longest phrases, least occurrences, percentage of them inside a longer phrase that drops one, rows per language.
LONGEST, LEAST, INSIDE, FIRST = 3, 10, 50, 2000
#: One of so many neighbouring pairs of words starts a chunk.
MODULUS = 12
#: Words counted together, and bytes of text parsed together.
WORDS, BYTES = 2_000_000, 2_000_000
#: Bits of the map: at least these, 32 for each surviving hash, and at most these (16 MB).
BITS_LEAST, BITS_MOST = 1 << 16, 1 << 27
#: A byte that no UTF-8 text has ends a piece.
END = b"\xff"
SIGNS = b".,;:!?\n\x0b\x0c\r"
LINE = bytes.maketrans(SIGNS + UPPER.encode(), END * len(SIGNS) + UPPER.lower().encode())
BYTES_ODD = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
ODD_A, ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of all neighbouring pairs of words."""
    return _mixed(h[:-1] * ODD_A + h[1:] * ODD_B)


# ---------------------------------------------------------------- the parse

def _parsed(line: bytes, tail: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a line of pieces, each with `END` behind it: words, owned words, and where it begins and bytes kept.

    White space between words becomes one space.
    """
    raw = np.frombuffer(line, np.uint8)
    gap = (raw == 32) | (raw == 9)
    end = raw == 255
    before = np.append(True, (gap | end)[:-1])
    kept = ~(gap & before)
    raw = np.where(gap, np.uint8(32), raw)[kept]
    split = (raw == 32) | (raw == 255)
    before = np.append(True, split[:-1])
    starts, stops = np.flatnonzero(~split & before), np.flatnonzero(split & ~before)
    if not len(starts):
        return [], starts, starts, kept
    piece = np.cumsum(raw == 255)[starts]
    # any function of the words will do for the borders: a sum over their bytes
    h = np.add.reduceat(np.where(split, np.uint64(0), BYTES_ODD[raw]), starts)
    opens = np.append(True, piece[1:] != piece[:-1])
    last = np.append(opens[1:], True)
    opens[:-1] |= ~last[:-1] & (_pairs(h) % np.uint64(MODULUS) == 0)
    first = np.flatnonzero(opens)
    behind = np.append(first[1:], len(starts))
    ends = np.flatnonzero(last)
    stop = np.minimum(behind + tail, ends[np.searchsorted(ends, first)] + 1)
    joined = raw.tobytes()
    found = [joined[i:j] for i, j in zip(starts[first].tolist(), stops[stop - 1].tolist())]
    return found, behind - first, starts[first], kept


def chunks(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """lang, chunk (words and a space between them), owned (words before the overlap) and freq.

    Spark sums up the chunks of a task before the shuffle, so a passage repeated in it leaves it once.
    """
    ship_package(df.sparkSession)
    tail = longest - 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, BYTES):
                texts = [(t.as_py() or "").encode().translate(LINE) + END for t in batch.column(1)]
                found, owned, at, kept = _parsed(b"".join(texts), tail)
                if not found:
                    continue
                sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                text_of = np.searchsorted(np.cumsum(kept)[sizes - 1], at, "right")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text_of)), pa.array(found, pa.binary()).cast(pa.string()),
                     pa.array(owned.astype(np.int32))], names=["lang", "chunk", "owned"])

    source = df.select(F.coalesce(F.col(name(lang)), F.lit("und")).alias("lang"), F.col(name(text)).alias("text"))
    parsed = source.mapInArrow(run, "lang string, chunk string, owned int")
    return parsed.groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("freq"))


class Block:
    """The words of many chunks: a number for each distinct one, hashes, and weights of owned places."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        lang, chunk, owned, freq = (c.chunk(0) for c in table.columns)
        cut = Words(chunk)
        self.words = pa.array(cut.words, pa.string())
        self.ids, self.size = cut.index, np.int64(len(cut.words))
        sizes = np.diff(cut.offsets)
        coded = lang.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = np.repeat(coded.indices.to_numpy().astype(np.int64), sizes)
        place = np.arange(len(self.ids)) - np.repeat(cut.offsets[:-1], sizes)
        #: how often the phrase that begins here counts, and words from here to the end of the chunk
        self.weight = np.where(place < np.repeat(owned.to_numpy(), sizes), np.repeat(freq.to_numpy(), sizes), 0)
        self.left = np.repeat(sizes, sizes) - place
        seeds = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in self.langs], np.uint64)
        own = np.array([xxhash.xxh64_intdigest(w) for w in cut.words], np.uint64)
        self.hashes = own[self.ids] ^ seeds[self.lang]


def _blocks(batches, limit: int) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # words are at least as many as spaces; chunks have a few
        size += pc.sum(pc.count_substring(batch.column(1), " ")).as_py() + batch.num_rows
        if size >= limit:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], order[first], np.add.reduceat(weight[order], first)


def frequent_pairs(parse: DataFrame, least: int = LEAST) -> DataFrame:
    """Hashes of two-word phrases with at least so many occurrences; different phrases may share one."""
    limit = WORDS

    def run(batches):
        for block in _blocks(batches, limit):
            some = np.flatnonzero((block.weight[:-1] > 0) & (block.left[:-1] > 1))
            if len(some):
                found, _, total = _summed(_pairs(block.hashes)[some], block.weight[some])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], names=["hash", "n"])

    return parse.select("lang", "chunk", "owned", "freq").mapInArrow(run, "hash long, n long").groupBy("hash").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of 64-bit words whose bits are set by hashes; its size is a power of two within fixed bounds."""
    kept, _ = store(hashes, "frequent-pairs")
    size = BITS_LEAST
    count = kept.count()
    while size < min(BITS_MOST, 32 * count):
        size *= 2
    cell = F.col("hash").bitwiseAND(size - 1)
    # at most BITS_MOST / 64 rows reach the driver
    words = kept.groupBy(F.shiftright(cell, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (hashes & np.uint64(63)) & np.uint64(1)) > 0


def counts(parse: DataFrame, bits: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n and words (in the phrase): all single words and every phrase that can be frequent."""
    shared = parse.sparkSession.sparkContext.broadcast(bits)
    limit = WORDS

    def run(batches):
        for block in _blocks(batches, limit):
            ids, left = block.ids, block.left
            pair = np.append(_set(shared.value, _pairs(block.hashes)), False)
            may = block.weight > 0
            keys = block.lang * block.size + ids
            for n in range(1, longest + 1):
                if n > 1:
                    # a phrase may be frequent if it goes on from one that may and its last two words may
                    may = may[:-1] & (left[:len(may) - 1] >= n) & pair[n - 2:len(may) + n - 3]
                    keys = _numbered(keys[:-1], ids[n - 1:], block.size, may)
                some = np.flatnonzero(may)
                if not len(some):
                    break
                _, at, total = _summed(keys[some], block.weight[some])
                at = some[at]
                words = [block.words.take(pa.array(ids[at + k])) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [block.langs.take(pa.array(block.lang[at])),
                     pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], pa.array(total)],
                    names=["lang", "phrase", "n"])

    return parse.select("lang", "chunk", "owned", "freq").mapInArrow(
        run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).withColumn(
        "words", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)


def _numbered(keys: np.ndarray, last: np.ndarray, size: np.int64, may: np.ndarray) -> np.ndarray:
    """Numbers of the phrases made of phrase number and last word, at the places that may hold one."""
    out = np.zeros(len(last), np.int64)
    # numbers of the shorter phrases stay below the number of places, so the product fits
    shorter = np.unique(keys[may], return_inverse=True)[1]
    out[may] = shorter * size + last[may]
    return out


# ---------------------------------------------------------------- collocations

def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score, words, cut.

    `a` counts the phrase, `l` and `r` the parts of its lowest-scoring cut, which is behind `cut` words, and
    `n` all words of the language.
    """
    spark = df.sparkSession
    parse, _ = store(chunks(df, text, lang, longest), "parse")
    shared = bit_map(frequent_pairs(parse, least))
    counted = counts(parse, shared, longest)
    # all parts of a frequent phrase are frequent; single words are summed up for n as well
    table, _ = store(counted.where((F.col("words") == 1) | (F.col("n") >= least)), "phrases")
    totals = table.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    parts, _ = store(table.where(F.col("n") >= least).select(
        F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), F.col("n").alias("p_n")), "phrase-parts")
    held = table.where((F.col("words") > 1) & (F.col("n") >= least)).select("lang", "words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ")

    cuts = held.select("lang", "words", "phrase", "a", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
            F.array_join(F.slice(word, F.lit(1), k), " ").alias("left"),
            F.array_join(F.slice(word, k + 1, F.col("words") - k), " ").alias("right")))).alias("pos", "sides"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts, (F.col("lang") == F.col("p_lang")) & (F.col(f"sides.{side}") == F.col("part"))).drop(
            "p_lang", "part").withColumnRenamed("p_n", count)
    # 14 digits each: the products have 34 and 28 at most
    digits = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    cuts = cuts.select("lang", "words", "phrase", "a", "l", "r", (F.col("pos") + 1).alias("cut"), (
        digits["a"] * digits["a"] * F.lit(1_000_000).cast("decimal(7,0)")).alias("over"), (
        digits["l"] * digits["r"]).alias("under")).withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    # what a longer phrase covers: all runs of its words
    covers = held.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
            F.sequence(F.lit(1), F.col("words") - k + 1),
            lambda i: F.array_join(F.slice(word, i, k), " "))))).alias("phrase"))
    longer = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(longer, ["lang", "phrase"], "left").where(stays).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score", "words", "best.cut").withColumn(
        "rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS a FROM pieces),
f1 AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, unnest(a) AS g FROM w) GROUP BY ALL),
f2 AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(a)),
  lambda i: a[i] || ' ' || a[i + 1])) AS g FROM w WHERE len(a) > 1) GROUP BY ALL),
f3 AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, unnest(list_transform(range(1, len(a) - 1),
  lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM w WHERE len(a) > 2) GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM f1 GROUP BY lang),
c2 AS (SELECT lang, g, c, string_split(g, ' ') AS p FROM f2 WHERE c >= 10),
c3 AS (SELECT lang, g, c, string_split(g, ' ') AS p FROM f3 WHERE c >= 10),
cuts AS (
  SELECT c2.lang, c2.g, c2.c AS a, 1 AS k, x.c AS l, y.c AS r FROM c2
  JOIN f1 x ON x.lang = c2.lang AND x.g = p[1] JOIN f1 y ON y.lang = c2.lang AND y.g = p[2]
  UNION ALL
  SELECT c3.lang, c3.g, c3.c, 1, x.c, y.c FROM c3
  JOIN f1 x ON x.lang = c3.lang AND x.g = p[1] JOIN f2 y ON y.lang = c3.lang AND y.g = p[2] || ' ' || p[3]
  UNION ALL
  SELECT c3.lang, c3.g, c3.c, 2, x.c, y.c FROM c3
  JOIN f2 x ON x.lang = c3.lang AND x.g = p[1] || ' ' || p[2] JOIN f1 y ON y.lang = c3.lang AND y.g = p[3]),
scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g, max(c) AS c FROM (
    SELECT lang, p[1] || ' ' || p[2] AS g, c FROM c3 UNION ALL SELECT lang, p[2] || ' ' || p[3], c FROM c3)
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g
  WHERE x.c IS NULL OR 100 * x.c < 50 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
