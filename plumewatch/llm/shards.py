"""Sharding to near-equal bytes by Karmarkar-Karp differencing.

Groups (equal texts) are indivisible. Differencing works on partial partitions: one sum for each shard,
at first a single item and zeros. The two partial partitions with the largest spread are combined in
opposite order, the largest sum of one with the smallest of the other, until one is left.

Groups of at least 1/`BINS` of a shard are items of their own; smaller ones are first added up by hash
into `BINS` bins for each shard. So the differencing always sees at most 2 x BINS x shards items, however
large the input, and the bins stay a thousandth of a shard. Nothing else reaches the driver.

Null texts have no bytes and group with empty ones; a row's size is its bytes plus one. Repeated rows get
slots of their own. A very long text is an item of its own and is never cut; only its size is moved. Items of
equal size go by their number, so ties are settled alike in every run. An empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumewatch.llm.frames import documents, name, store

BINS = 1024


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The shard of each item. Sums as equal as differencing makes them; ties go by item number."""
    if not sizes:
        return []
    # (minus spread, number, [(sum over the smallest sum, members), ...] in falling order)
    heap = [(-s, i, [(s, i)] + [(0, None)] * (ways - 1)) for i, s in enumerate(sizes)]
    heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heappop(heap)
        _, _, b = heap[0]
        joined = [(x + y, n if m is None else m if n is None else (m, n))
                  for (x, m), (y, n) in zip(a, reversed(b))]
        joined.sort(key=lambda slot: -slot[0])
        least = joined[-1][0]
        heapreplace(heap, (least - joined[0][0], count, [(x - least, m) for x, m in joined]))
        count += 1
    shards = [0] * len(sizes)
    for shard, (_, members) in enumerate(heap[0][2]):
        stack = [] if members is None else [members]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                stack.extend(top)
            else:
                shards[top] = shard
    return shards


def shard(df: DataFrame, shards: int = 16, text: str = "text", row_id: str = "doc_id",
          bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = df.sparkSession
    content = F.coalesce(F.col(name(text)), F.lit(""))
    rows, _ = store(df.select(
        F.col(name(row_id)).alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.xxhash64(content).alias("key"),
        F.spark_partition_id().alias("part")), "shard-rows")
    bins = bins * shards
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = max(1, -(-total // bins))
    # equal texts; the key holds size and checksum too, and a clash would only keep two texts together
    groups = rows.groupBy("key", "size", "text_crc32").agg(
        (F.col("size") * F.count(F.lit(1))).alias("bytes"))
    own = F.col("bytes") >= large
    items = groups.select(
        F.when(own, F.col("key")).alias("key"), F.when(own, F.col("size")).alias("size"),
        F.when(own, F.col("text_crc32")).alias("text_crc32"),
        F.when(~own, F.pmod("key", F.lit(bins))).alias("bin"), "bytes",
    ).groupBy("key", "size", "text_crc32", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r.bytes, r.bin is None, r.bin or 0, r.key or 0, r.text_crc32 or 0))
    placed = differencing([r.bytes for r in items], shards)
    singles = spark.createDataFrame(
        [(r.key, r.size, r.text_crc32, s) for r, s in zip(items, placed) if r.bin is None],
        "key long, size long, text_crc32 long, own_shard int")
    small = spark.createDataFrame(
        [(r.bin, s) for r, s in zip(items, placed) if r.bin is not None], "bin long, bin_shard int")
    # both tables have at most bins x shards rows of some 30 bytes
    dealt = rows.withColumn("bin", F.pmod("key", F.lit(bins))).join(
        F.broadcast(singles), ["key", "size", "text_crc32"], "left").join(
        F.broadcast(small), "bin", "left").select(
        "doc_id", "size", "text_crc32", "part",
        F.coalesce("own_shard", "bin_shard").alias("shard"))
    # slots: numbers within (shard, part of the stored table) plus the rows of the parts before
    cell = dealt.groupBy("shard", "part").count().select(
        F.col("shard").alias("c_shard"), F.col("part").alias("c_part"),
        (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
        .alias("before"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("number", F.row_number().over(inner)).join(
        cell, (F.col("shard") == F.col("c_shard")) & (F.col("part") == F.col("c_part"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))


def op2_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
