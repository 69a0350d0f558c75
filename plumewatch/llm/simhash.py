"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits, and of two that differ in at most three bits one half differs in at most one.
In each half the anchors are the 2^26 words of the Hamming code of length 31, whose covering radius is
one: every half word has an anchor within distance 1, its home. A fingerprint is replicated to every
anchor within the radius plus the threshold, which is distance 2: sixteen at most. Whatever is within one
bit of a fingerprint's half visits its home, so comparing each anchor's homes with its visitors, over all
64 bits, loses no link.

Anchors with many homes are cut into chunks of `CHUNK` homes, and visitors go to each chunk. A task keeps
one chunk of homes and reads the visitors in batches. It emits the links of a batch as stars, never as
pairs, so that a dense group of near copies gives no more rows than it has fingerprints and visits.
Equal fingerprints are joined before all this.

Texts that are null or have no word have fingerprint zero and are linked like others; a text of one or
two words is one shingle. Repeated rows and ties share a fingerprint. Very long texts are hashed whole, in blocks
of `BLOCK` shingles. Null ids are never the smallest of a component. An empty table gives an empty table; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, name, packed, store
from plumewatch.llm.graph import components, forest
from plumewatch.session import ship_package

#: Words in a shingle.
SHINGLE = 3
#: Most differing bits of linked fingerprints. The anchors are laid out for this number.
BITS = 3
HASH_SEED = 42
#: Homes compared at a time.
CHUNK = 4096
#: Shingles hashed at a time.
BLOCK = 65_535
#: Pairs compared at a time.
PAIRS = 2_000_000
#: Words in a shingle of the similarity that near copies are judged by, and the least similarity in tenths.
JUDGED, LEAST = 5, 8
#: Bands and smallest hashes in each: of pairs with similarity 0.8 a share of 1 - (1 - 0.8^5)^20 = 99.96 % meets.
BANDS, DEPTH = 20, 5
#: Texts of a group compared with each other in a task, and those of them that all tasks of a group have.
TEXTS, PIVOTS = 256, 8
#: Shingles whose smallest hashes are taken at a time, and columns of a block of common shingles.
HASHES, COLUMNS = 1_000_000, 8_192


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles; number 0 keeps them."""
    if not number:
        return hashes
    h = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(odd)
    return h ^ h >> np.uint64(32)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of the word shingles: a bit is set if it is set in over half of their hashes."""
    return fingerprints_of(text, words, 1)[0]


def fingerprints_of(text: str | None, words: int = SHINGLE, prints: int = 1) -> list[int]:
    """Several independent SimHashes of one text; the first one is that of the plain hashes."""
    # bytes.lower and bytes.split know ASCII only, as the definition of words does
    parts = (text or "").encode().lower().split()
    if not parts:
        return [0] * prints
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    lows, highs = starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, total, count = xxhash.xxh64_intdigest, np.zeros((prints, 64), np.int64), len(lows)
    for at in range(0, count, BLOCK):
        hashes = np.array([digest(line[i:j], HASH_SEED) for i, j in
                           zip(lows[at:at + BLOCK], highs[at:at + BLOCK])], np.uint64)
        for number in range(prints):
            bits = np.unpackbits(_mixed(hashes, number).view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            # eight counters of eight bits in a word, over at most 255 rows each
            lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(hashes), 255), axis=0)
            total[number] += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > count, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(df: DataFrame, text: str = "text", words: int = SHINGLE, out: str = "print") -> DataFrame:
    """The other columns of `df` with the fingerprint as a signed long. One pass, no shuffle."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, out)]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(c)) for c in kept] + [pa.array(found, pa.int64())],
                names=[*kept, out])

    schema = df.select(*[name(c) for c in kept], F.lit(0).cast("long").alias(out)).schema
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- anchors

def _syndrome(half: np.ndarray) -> np.ndarray:
    """Exclusive or of the places (1 to 31) of the bits that are set."""
    out = np.zeros_like(half)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out |= (np.bitwise_count(half & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, roles (0 home, 1 visit) and fingerprints; `prints` are unsigned."""
    one, low = np.uint64(1), np.uint64((1 << 31) - 1)
    keys, roles, owners = [], [], []

    def put(half, words, role, own):
        keys.append(np.uint64(half << 40) | words)
        roles.append(np.full(len(words), role, np.int8))
        owners.append(own)

    def bit(place):
        return np.where(place > 0, one << (np.maximum(place, one) - one), np.uint64(0))

    for half in (0, 1):
        part = (prints >> np.uint64(32 * half)) & low
        s = _syndrome(part)
        home = part ^ bit(s)
        put(half, home, 0, prints)
        put(half, home, 1, prints)
        # two flipped places i < j whose numbers' exclusive or is the syndrome
        for i in range(1, 32):
            first = np.uint64(i)
            second = s ^ first
            some = (s > 0) & (second > first)
            put(half, (part ^ (one << (first - one)) ^ bit(second))[some], 1, prints[some])
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(owners)


def _replicate(batches):
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(whole), 20_000):
            keys, roles, owners = anchors(whole[at:at + 20_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(roles), pa.array(owners.view(np.int64))],
                names=["key", "role", "print"])


def _compare(batches):
    """Homes against visitors of each (key, chunk); rows come sorted, homes first."""
    held_key, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        chunk = batch.column(1).to_numpy(zero_copy_only=False)
        role = batch.column(2).to_numpy(zero_copy_only=False)
        own = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        continued = held_key == (key[0], chunk[0])
        if continued:
            n = len(held)
            key, chunk = np.concatenate([np.full(n, key[0]), key]), np.concatenate(
                [np.full(n, chunk[0]), chunk])
            role = np.concatenate([np.zeros(n, role.dtype), role])
            own = np.concatenate([held, own])
        fresh_at = np.flatnonzero(np.concatenate(
            [[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
        sizes = np.diff(np.append(fresh_at, len(key)))
        homes = np.add.reduceat(role == 0, fresh_at)
        last = fresh_at[-1]
        held_key, held = (key[-1], chunk[-1]), own[last:][role[last:] == 0].copy()
        # each visitor meets the homes at the head of its run
        run = np.repeat(np.arange(len(sizes)), sizes)
        # a home and its own visit give no link; part of a run that began in another batch says nothing of its size
        whole = sizes > 2
        whole[0] |= continued
        visits = np.flatnonzero((role == 1) & (homes[run] > 0) & whole[run])
        meets = homes[run[visits]]
        upto = np.cumsum(meets)
        left, right = [], []
        at = 0
        while at < len(visits):
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
            some, times = visits[at:to], meets[at:to]
            a = np.repeat(own[some], times)
            offset = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            b = own[np.repeat(fresh_at[run[some]], times) + offset]
            apart = np.bitwise_count(a ^ b)
            near = (apart > 0) & (apart <= BITS)
            x, y = forest(a[near].view(np.int64), b[near].view(np.int64))
            left.append(x)
            right.append(y)
            at = to
        if left:
            x, y = forest(np.concatenate(left), np.concatenate(right))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Stars `a`, `b` that connect the distinct fingerprints (column `print`) as their links do."""
    ship_package(prints.sparkSession)
    placed = prints.select("print").mapInArrow(_replicate, "key long, role byte, print long")
    homes = prints.select("print").mapInArrow(
        _homes, "key long").groupBy("key").count().where(F.col("count") > CHUNK)
    hot, _ = store(homes.select(F.col("key").alias("h_key"), F.ceil(F.col("count") / CHUNK).cast("int")
                                .alias("chunks")), "hot-anchors")
    if hot.isEmpty():
        placed = placed.select("key", F.lit(0).alias("chunk"), "role", "print")
    else:
        all_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
        own_chunk = F.array(F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
        placed = placed.join(hot, F.col("key") == F.col("h_key"), "left").select(
            "key", F.explode_outer(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(
                F.col("role") == 0, own_chunk).otherwise(all_chunks)).alias("chunk"), "role", "print")
    return placed.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role").mapInArrow(
        _compare, "a long, b long")


def _homes(batches):
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        one, low = np.uint64(1), np.uint64((1 << 31) - 1)
        keys = []
        for half in (0, 1):
            part = (whole >> np.uint64(32 * half)) & low
            s = _syndrome(part)
            flip = np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
            keys.append(np.uint64(half << 40) | (part ^ flip))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])


def classes(rows: DataFrame) -> DataFrame:
    """Distinct fingerprints (`c_print`) with the smallest id of their component.

    `rows` is a stored table with doc_id and print.
    """
    distinct, _ = store(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(distinct), "print-components")
    labelled = distinct.join(found, F.col("print") == F.col("node"), "left").select(
        F.col("print").alias("c_print"), F.coalesce("root", "print").alias("root"), "least")
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(lowest, "root").select("c_print", "root", "component_id")


def clusters(df: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    rows, _ = store(fingerprints(df.select(
        F.col(name(row_id)).alias("doc_id"), F.col(name(text)).alias("text")), words=words), "doc-prints")
    return rows.join(classes(rows), F.col("print") == F.col("c_print")).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity

def shingles(text: str | None, words: int = JUDGED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text without words has one, of the empty shingle."""
    parts = (text or "").encode().lower().split()
    digest, k = xxhash.xxh64_intdigest, min(words, len(parts))
    return np.unique(np.array([digest(b" ".join(parts[i:i + k]), HASH_SEED)
                               for i in range(len(parts) - k + 1)], np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """For each set `BANDS` keys; two sets share a key if the smallest hashes of a band agree."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + HASHES, "right")))
        hashes = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], sizes[at:to - 1] - base]).astype(np.int64)
        for band in range(BANDS):
            key = np.full(to - at, band, np.uint64)
            for number in range(band * DEPTH, (band + 1) * DEPTH):
                key = _mixed(key ^ np.minimum.reduceat(_mixed(hashes, number + 1), starts), BANDS * DEPTH + 1)
            out[at:to, band] = key
        at = to
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose sets have at least `LEAST` tenths of their union in common."""
    found, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    # neighbouring columns hold common shingles, the others are left out
    common = np.bincount(column, minlength=len(found)) > 1
    place = np.where(common, np.cumsum(common) - 1, -1)[column]
    sizes = np.array([len(s) for s in (*left, *right)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    n, shared = len(left), np.zeros((len(left), len(right)))
    for low in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(place, (low, low + COLUMNS))
        block = np.zeros((len(sizes), min(COLUMNS, int(common.sum()) - low)), np.float32)
        block[row[i:j], place[i:j] - low] = 1
        shared += block[:n] @ block[n:].T
    union = sizes[:n, None] + sizes[None, n:] - shared
    return np.nonzero(10 * shared >= LEAST * union)


def _judge(inner: bool):
    """Homes of each (root, chunk) against the guests that follow them, with `inner` also with each other."""

    def run(batches):
        key, homes, owners, guests, visits = None, [], [], [], []

        def met(sets, own):
            x, y = similar(sets, homes)
            a, b = np.array(own, np.int64)[x], np.array(owners, np.int64)[y]
            a, b = forest(a[a != b], b[a != b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def close():
            if inner and len(homes) > 1:
                yield from met(homes, owners)
            if homes and guests:
                yield from met(guests, visits)

        for batch in batches:
            for root, chunk, role, rid, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                if key != (root, chunk):
                    yield from close()
                    key, homes, owners, guests, visits = (root, chunk), [], [], [], []
                if role == 0:
                    homes.append(shingles(text.as_py()))
                    owners.append(rid)
                    continue
                guests.append(shingles(text.as_py()))
                visits.append(rid)
                if len(guests) == TEXTS and homes:
                    yield from met(guests, visits)
                    guests, visits = [], []
        yield from close()

    return run


def _judged(placed: DataFrame, inner: bool) -> DataFrame:
    table = placed.select("root", "chunk", "role", "rid", "text").repartition("root", "chunk")
    return store(table.sortWithinPartitions("root", "chunk", "role").mapInArrow(
        _judge(inner), "a long, b long"), "similar-texts")[0]


def similar_groups(members: DataFrame) -> DataFrame:
    """`node` and `root` of the texts (rid, root, text) that pairs of similar texts of one root connect.

    All pairs of a root count. A root of up to `TEXTS` texts is one task's work. A larger one is cut into
    chunks; a first pass compares the texts of each chunk with each other and with a few pivots, which
    connects a dense group. Only the texts left outside its largest group then meet all chunks.
    """
    ship_package(members.sparkSession)
    sizes, _ = store(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > TEXTS).select(F.col("root").alias("h_root"), F.ceil(F.col("n") / TEXTS).cast("int").alias(
            "chunks")), "large-roots")
    if sizes.isEmpty():
        edges = _judged(members.select("root", F.lit(0).alias("chunk"), F.lit(0).alias("role"), "rid", "text"), True)
        return components(edges, "similar-groups")
    cut, _ = store(members.join(sizes, F.col("root") == F.col("h_root"), "left").select(
        "root", "rid", "text", F.coalesce("chunks", F.lit(1)).alias("chunks"),
        F.pmod(F.xxhash64("rid"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk")), "cut-texts")
    homes = cut.select("root", "chunk", F.lit(0).alias("role"), "rid", "text")

    def guests(rows):
        return rows.select("root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                           F.lit(1).alias("role"), "rid", "text")

    large = cut.where("chunks > 1")
    # `row_number` is applied inside each task before the shuffle
    first = large.select("root", "rid").withColumn("place", F.row_number().over(
        Window.partitionBy("root").orderBy("rid"))).where(F.col("place") <= PIVOTS).select("rid")
    edges = _judged(homes.unionByName(guests(large.join(first, "rid", "left_semi"))), True)
    found = components(edges, "similar-groups")
    parts, _ = store(large.select("root", "rid").join(found.select(
        F.col("node").alias("rid"), F.col("root").alias("part")), "rid", "left").select(
        "root", "rid", F.coalesce("part", "rid").alias("part")), "similar-parts")
    most = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(
        F.max(F.struct("n", "part")).alias("most"))
    outside, _ = store(parts.join(most, "root").where("part <> most.part").select("root", "rid"), "outside-texts")
    if outside.isEmpty():
        return found
    # roots that the first pass connected whole are done
    open_roots = outside.select("root").distinct()
    again = homes.join(open_roots, "root", "left_semi").unionByName(
        guests(cut.join(outside.select("rid"), "rid", "left_semi")))
    return components(edges.unionByName(_judged(again, False)), "similar-groups")


def print_tables(df: DataFrame, text: str, words: int, prints: int, out: str = "prints",
                 keys: str = "bands") -> DataFrame:
    """The other columns of `df` with an array of independent fingerprints and one of band keys."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, out, keys)]

    def lists(found):
        flat = pa.array(found.reshape(-1).view(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), flat)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                texts = [t.as_py() for t in batch.column(batch.schema.names.index(text))]
                found = np.array([fingerprints_of(t, words, prints) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.names.index(c)) for c in kept]
                    + [lists(found), lists(bands([shingles(t) for t in texts]))], names=[*kept, out, keys])

    schema = df.select(*[name(c) for c in kept], F.array().cast("array<long>").alias(out),
                       F.array().cast("array<long>").alias(keys)).schema
    return df.mapInArrow(run, schema)


def near_groups(rows: DataFrame, prints: int) -> DataFrame:
    """`node` and `root` of the rows (rid, prints, bands) that any fingerprint or band links with others."""
    edges = None
    for k in range(prints):
        own = rows.select("rid", F.col("prints")[k].alias("print"))
        table, _ = store(own.groupBy("print").agg(F.min("rid").alias("rep")), "print-table")
        stars = links(table.select("print")).join(
            table.select(F.col("print").alias("a"), F.col("rep").alias("x")), "a").join(
            table.select(F.col("print").alias("b"), F.col("rep").alias("y")), "b")
        same = own.join(table, "print").where("rid <> rep")
        part = stars.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
            same.select(F.col("rid").alias("a"), F.col("rep").alias("b")))
        edges = part if edges is None else edges.unionByName(part)
    held = rows.select("rid", F.explode("bands").alias("band"))
    shared, _ = store(held.groupBy("band").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("band", "rep"), "band-table")
    met = held.join(shared, "band").where("rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b"))
    return components(edges.unionByName(met.distinct()), "near-groups")


def dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = 2, prints: int = 4,
          ) -> DataFrame:
    """One row of each near-duplicate group, with its own columns: the one with the smallest id.

    Rows belong together if a chain of pairs connects them whose sets of five-word shingles have at least
    0.8 of their union in common. Candidates are the groups linked by any of `prints` independent
    fingerprints of word shingles or by equal bands of smallest hashes; inside these groups the whole texts
    are compared, and no candidate link counts by itself (figures in the README).

    Of several rows with the smallest id, the one whose text has the smallest hash stays, one of them if
    they are equal. Texts are shuffled for the semi-joins with the candidates and with the rows that stay.
    """
    content = F.xxhash64(F.coalesce(F.col(name(text)), F.lit("")))
    rows, _ = store(print_tables(df.select(
        F.col(name(row_id)).alias("doc_id"), content.alias("content"),
        F.monotonically_increasing_id().alias("rid"), F.col(name(text)).alias("text")),
        "text", words, prints), "print-rows")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "content")
    # equal texts are one from here on
    texts, _ = store(rows.groupBy("content", "prints", "bands").agg(
        F.min(order).alias("first"), F.min("rid").alias("rid")), "print-texts")
    groups, _ = store(texts.select("rid", "first").join(near_groups(texts, prints), F.col("rid") == F.col("node")).select(
        "rid", "root", F.col("first.doc_id").alias("s_id"), F.col("first.content").alias("s_content")), "candidates")
    members, _ = store(df.select(
        F.col(name(row_id)).alias("id"), content.alias("content"), F.col(name(text)).alias("text")).join(
        groups, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("content") == F.col("s_content"))).select(
        "rid", "root", "text").dropDuplicates(["rid"]), "candidate-texts")
    found = texts.select("rid", "first").join(similar_groups(members), F.col("rid") == F.col("node"), "left")
    stay = found.groupBy(F.coalesce("root", "rid")).agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("s_id"), F.col("first.content").alias("s_content")).distinct()
    ids = Window.partitionBy("id", "content").orderBy(F.lit(1))
    return df.select(packed(df).alias("row"), F.col(name(row_id)).alias("id"), content.alias("content")).join(
        stay, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("content") == F.col("s_content")),
        "left_semi").withColumn("copy", F.row_number().over(ids)).where("copy = 1").select("row.*")


def op5_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(documents(spark, sf_dir).select("doc_id", "text"))
