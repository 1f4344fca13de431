"""Cutting files into chunks: fixed sizes as an expression, content-defined boundaries in Arrow batches."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed and size of the table of the gear hash, so that boundaries agree with published packs.
GEAR_SEED, GEAR_SIZE = 0x434C4432, 256
FIXED_SIZE = 256
CDC_MIN, CDC_AVG, CDC_MAX = 64, 256, 1024


def gear_table() -> np.ndarray:
    source = random.Random(GEAR_SEED)
    return np.array([source.getrandbits(64) for _ in range(GEAR_SIZE)], dtype=np.uint64)


def fixed_chunks(tree: DataFrame, size: int = FIXED_SIZE, payload: bool = False) -> DataFrame:
    """(path, file_offset, raw_len, chunk_id): a chunk every `size` bytes, the last shorter; an empty file has none. With the bytes if asked."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    at = F.expr(f"if(octet_length(content) > 0, sequence(0, octet_length(content) - 1, {size}), array())")
    cut = tree.select("path", "content", F.explode(at).alias("file_offset"))
    part = F.substring("content", F.col("file_offset") + 1, F.lit(size))
    return cut.select("path", F.col("file_offset").cast("bigint").alias("file_offset"), F.octet_length(part).cast("bigint").alias("raw_len"), F.sha2(part, 256).alias("chunk_id"), *([part.alias("payload")] if payload else []))


def _bits(avg: int) -> int:
    return max(int(avg).bit_length() - 1, 0)


def _window_sums(gear: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the hash at each byte: the last `bits` bytes decide them."""
    acc = np.zeros(len(gear), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(bits, len(gear))):
            acc[j:] += gear[: len(gear) - j] << np.uint64(j)
    return acc & np.uint64((1 << bits) - 1)


def gear_cuts(data: np.ndarray, gear: np.ndarray, low: int, avg: int, high: int) -> list[int]:
    """Ends of chunks: after a byte whose hash since the chunk's beginning has its low bits clear, within low and high."""
    bits, n = _bits(avg), len(data)
    values = gear[data]
    sums = _window_sums(values, bits)
    clear = np.flatnonzero(sums == 0)
    cuts, start = [], 0
    while start < n:
        end = min(start + high, n)
        first = start + low - 1  # the first byte after which a cut may fall
        # bytes whose window reaches back over the chunk's beginning are summed again
        near = min(start + bits - 1, end)
        for at in range(max(first, start), near):
            if int(_window_sums(values[start : at + 1], bits)[-1]) == 0:
                end = at + 1
                break
        else:
            k = int(np.searchsorted(clear, max(first, near)))
            if k < len(clear) and clear[k] + 1 <= end:
                end = int(clear[k]) + 1
        cuts.append(end)
        start = end
    return cuts


def normalised_cuts(data: np.ndarray, gear: np.ndarray, low: int, avg: int, high: int, stride: int = 1) -> list[int]:
    """Ends of chunks: the scan begins `low` bytes in, asks for one bit more up to `avg` and for one less beyond."""
    bits, n = _bits(avg), len(data)
    strict, easy = bits + 1, max(bits - 1, 0)
    cuts, start = [], 0
    values = gear[data]
    while start < n:
        if n - start <= max(low, 1):
            cuts.append(n)
            break
        end = min(start + high, n)
        seen = np.arange(start + low, end, stride)
        sums = _window_sums(values[seen], strict)
        hit = np.where(seen < start + avg, sums == 0, (sums & np.uint64((1 << easy) - 1)) == 0)
        if hit.any():
            end = int(seen[int(hit.argmax())]) + 1
        cuts.append(end)
        start = end
    return cuts


def content_chunks(tree: DataFrame, mode: str = "cdc", low: int = CDC_MIN, avg: int = CDC_AVG, high: int = CDC_MAX, stride: int = 16, payload: bool = False) -> DataFrame:
    """(path, file_offset, raw_len, chunk_id) by `gear`, `cdc` (normalised) or `fastcdc` (normalised, strided). With the bytes if asked."""
    import hashlib

    if mode not in ("gear", "cdc", "fastcdc"):
        raise ValueError(f"unknown chunker {mode!r}")
    if not 0 < low <= avg <= high or stride <= 0:
        raise ValueError("chunk sizes must rise from a positive minimum, and the stride be positive")

    def run(batches):
        gear = gear_table()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
                cuts = gear_cuts(data, gear, low, avg, high) if mode == "gear" else normalised_cuts(data, gear, low, avg, high, stride if mode == "fastcdc" else 1)
                for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
                    rows.append((path, a, b - a, hashlib.sha256(data[a:b]).hexdigest(), data[a:b].tobytes() if payload else b""))
            if rows:
                p, a, n, h, body = zip(*rows, strict=True)
                arrays = [pa.array(p), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(h), *([pa.array(body, pa.binary())] if payload else [])]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "file_offset", "raw_len", "chunk_id", "payload"][: len(arrays)])

    return tree.select("path", "content").mapInArrow(run, "path string, file_offset bigint, raw_len bigint, chunk_id string" + (", payload binary" if payload else ""))


# Other names of the chunkers, and the sizes of a release that names none.
ALIASES = {"normalized-cdc": "cdc", "cdc-fast": "fastcdc", "gear-cdc": "gear"}


@dataclass(frozen=True)
class Cutting:
    """How files are cut."""

    mode: str = "cdc"
    fixed_size: int = 256 << 10
    min: int = 64 << 10
    avg: int = 256 << 10
    max: int = 1 << 20
    stride: int = 16

    def __call__(self, tree: DataFrame, payload: bool = False) -> DataFrame:
        mode = ALIASES.get(self.mode, self.mode)
        if mode == "fixed":
            return fixed_chunks(tree, self.fixed_size, payload)
        return content_chunks(tree, mode, self.min, self.avg, self.max, self.stride, payload)


def gear_candidates(tree: DataFrame, avg: int = CDC_AVG) -> DataFrame:
    """(path, position): bytes of a file after which the low bits of the unbroken gear hash are clear."""
    bits = _bits(avg)

    def run(batches):
        gear = gear_table()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if raw is None or not len(raw):
                    continue
                at = np.flatnonzero(_window_sums(gear[np.frombuffer(raw, dtype=np.uint8)], bits) == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at.astype(np.int64))], ["path", "position"])

    return tree.select("path", "content").mapInArrow(run, "path string, position bigint")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Over all references: number, least, mean (two decimals) and largest length; zeros when there are none."""
    return chunks.agg(
        F.count("*").alias("chunk_refs"),
        F.coalesce(F.min("raw_len"), F.lit(0)).cast("bigint").alias("min_len"),
        F.coalesce(F.sum("raw_len"), F.lit(0)).cast("bigint").alias("total_len"),
        F.coalesce(F.max("raw_len"), F.lit(0)).cast("bigint").alias("max_len"),
    ).withColumn("avg_len", F.when(F.col("chunk_refs") > 0, F.bround(F.col("total_len") / F.col("chunk_refs"), 2)).otherwise(F.lit(0.0)))


def chunk_sql(view: str, size: int = FIXED_SIZE) -> str:
    """fixed_chunks of a common table expression, for DuckDB."""
    return f"(SELECT path, CAST(o AS BIGINT) AS file_offset, CAST(least({size}, octet_length(content) - o) AS BIGINT) AS raw_len, sha256(array_slice(content, o + 1, least(o + {size}, octet_length(content)))) AS chunk_id FROM (SELECT path, content, unnest(range(0, CAST(octet_length(content) AS BIGINT), {size})) AS o FROM {view}))"


def chunk_bits(avg: int = CDC_AVG) -> int:
    return _bits(avg)
