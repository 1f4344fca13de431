"""Reading byte ranges: slices of a column, and of remote or local packs with retries and validation."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers after which a request is made again.
RETRIED = {408, 425, 429, 500, 502, 503, 504}


def pack_slices(packs: DataFrame, start: Column, length: int) -> DataFrame:
    """(path, start, length, sha256) of one range of every pack(path, content, size); ranges beyond the end are cut."""
    at = start.cast("int")
    part = F.substring("content", at + 1, F.lit(length))
    return packs.where(F.col("size") > at).select("path", at.cast("bigint").alias("start"), F.octet_length(part).cast("bigint").alias("length"), F.sha2(part, 256).alias("sha256"))


def read_local_range(path: str, start: int, length: int) -> bytes:
    with open(path, "rb") as file:
        file.seek(start)
        data = file.read(length)
    if len(data) != length:
        raise OSError(f"short read: {len(data)} of {length} bytes")
    return data


def read_url_range(url: str, start: int, length: int, etag: str | None = None, retries: int = 3, backoff: float = 0.2) -> bytes:
    """A range over HTTP. A whole answer is accepted only where no tag was held against it."""
    if length == 0:
        return b""
    ask = urllib.request.Request(url, headers={"Range": f"bytes={start}-{start + length - 1}", **({"If-Range": etag} if etag else {})})
    last: Exception | None = None
    for attempt in range(max(1, retries)):
        if attempt:
            time.sleep(backoff * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(ask, timeout=30) as answer:
                data = answer.read()
                if answer.status == 200:
                    if etag:
                        raise OSError("the object has changed")
                    data = data[start : start + length]
                if len(data) == length:
                    return data
                last = OSError(f"short range: {len(data)} of {length} bytes")
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED:
                raise
            last = error
        except (OSError, http.client.HTTPException) as error:  # a cut answer is the latter
            last = error
    raise last


def read_mirrors(read, mirrors: list[str]) -> bytes:
    """The first mirror that answers."""
    errors = []
    for mirror in mirrors:
        try:
            return read(mirror)
        except OSError as error:
            errors.append(f"{mirror}: {error}")
    raise OSError("; ".join(errors[:5]))
