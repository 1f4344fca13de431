"""`spark.read.format("chunkrepo")`: the bytes of named ranges of pack files, one task per share of the ranges.

Options: path (a pack file or http address), ranges (`start:length,...`), shares, etag, retries.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import read_local_range, read_url_range


class Share(InputPartition):
    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = ranges


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.etag, self.retries = options["path"], options.get("etag"), int(options.get("retries", "3"))
        self.ranges = [tuple(map(int, x.split(":"))) for x in options.get("ranges", "").split(",") if x]
        self.shares = max(1, int(options.get("shares", "8")))

    def partitions(self):
        return [Share(self.ranges[k :: self.shares]) for k in range(min(self.shares, max(1, len(self.ranges))))]

    def read(self, partition):
        remote = self.path.startswith(("http://", "https://"))
        for start, length in partition.ranges:
            yield start, length, read_url_range(self.path, start, length, self.etag, self.retries) if remote else read_local_range(self.path, start, length)


class ChunkRepo(DataSource):
    @classmethod
    def name(cls):
        return "chunkrepo"

    def schema(self):
        return "start bigint, length bigint, payload binary"

    def reader(self, schema):
        return ChunkReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ChunkRepo)
