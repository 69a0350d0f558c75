"""Parquet footers as a table: what every shard says it holds, without reading its rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumewatch.session import ship_package

FORMAT = "parquet_footers"
#: Footers read by a task.
SHARDS = 64


class Shards(InputPartition):
    def __init__(self, found: list[tuple[str, int]]):
        self.found = found


def _store(path: str):
    """File system and path inside it; plain paths are local ones."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if not urlsplit(path).scheme:
        return LocalFileSystem(), path
    return FileSystem.from_uri(path)


class FooterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Shards]:
        from pyarrow.fs import FileSelector, FileType

        files, inside = _store(self.path)
        one = files.get_file_info(inside)
        listed = [one] if one.type == FileType.File else files.get_file_info(FileSelector(inside, recursive=True))
        # hidden files are no shards, nor is anything in a hidden folder
        found = sorted((f.path, f.size) for f in listed if f.type == FileType.File and f.path.endswith(".parquet")
                       and not any(p[:1] in "._" for p in f.path[len(inside):].split("/") if p))
        return [Shards(found[i:i + SHARDS]) for i in range(0, len(found), SHARDS)] or [Shards([])]

    def read(self, partition: Shards) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, _ = _store(self.path)
        parts = urlsplit(self.path)
        root = f"{parts.scheme or 'file'}://{parts.netloc}"
        for path, length in partition.found:
            try:
                with files.open_input_file(path) as file:
                    footer = pq.read_metadata(file)
                yield f"{root}{path}", length, footer.num_row_groups, footer.num_rows, True
            except (pa.ArrowException, OSError):
                yield f"{root}{path}", length, None, None, False


class ParquetFooters(DataSource):
    """``spark.read.format("parquet_footers").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length long, row_groups int, rows long, readable boolean"

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])


def first_byte(path: str, row_group: int) -> int:
    """Where the first page of a row group begins."""
    import pyarrow.parquet as pq

    files, inside = _store(path)
    with files.open_input_file(inside) as file:
        column = pq.read_metadata(file).row_group(row_group).column(0)
    return column.dictionary_page_offset or column.data_page_offset


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """Full path, bytes, row groups, rows and readability of every shard below a folder."""
    ship_package(spark)
    spark.dataSource.register(ParquetFooters)
    return spark.read.format(FORMAT).load(path)


def short_shards(frames: DataFrame, footers: DataFrame) -> DataFrame:
    """The shards that gave other rows than their footers say, with `rows_read`.

    `frames` is a scan that passes over unreadable parts. All of its columns are read, because damage may sit
    in any of them.
    """
    shard = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    every = F.xxhash64(*[F.col(c) for c in frames.columns])
    read = frames.select(shard.alias("shard"), every.alias("row")).groupBy("shard").agg(
        # a count alone would be taken from the footers; the sum over all values makes Spark read them
        F.when(F.bit_xor("row").isNotNull(), F.count(F.lit(1))).alias("rows_read"))
    counted = footers.join(read, F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace(
        "shard", "^file:/+", "/"), "left").drop("shard").withColumn(
        "rows_read", F.coalesce("rows_read", F.lit(0).cast("long")))
    return counted.where(~F.col("readable") | (F.col("rows") != F.col("rows_read")))
