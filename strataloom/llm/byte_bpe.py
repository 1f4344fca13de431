"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte is mapped to a printable character, each vocabulary entry to the string of its bytes' characters, scored
by its negative rank; the normaliser is the identity. A pre-token is its entry where it is one, and otherwise what
sentencepiece's merges make of it, which is the order of the ranks. Decoding maps ids back to bytes.

Defined results: a null text counts as empty; an empty text has no ids; any text decodes to its own UTF-8 bytes; rows
may repeat, other columns are carried or ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Entries of a worker's pre-token cache.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are not kept.
CACHED_BYTES = 64


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a tiktoken rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    table = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for word, rank in pairs:
        table[int(rank)] = base64.b64decode(word)
    return table


def byte_characters() -> list[str]:
    """A distinct printable character for each byte: itself where it is one, else U+0100 upwards."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protobuf field: varint, length-delimited or 32-bit float by the type of the value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is rank i, one unknown piece follows. Field numbers are the format's."""
    bpe, normal, unknown = 2, 1, 2
    chars = byte_characters()
    out = bytearray()
    for rank, word in enumerate(ranks):
        piece = "".join(chars[b] for b in word) or f"{rank}"  # a gap in the ranks stays a gap
        out += _field(1, _field(1, piece.encode()) + _field(2, -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, b"\xee\x80\x80") + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False))
    return bytes(out)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.whole = {word: rank for rank, word in enumerate(self.ranks) if word}
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, tuple[str, bytes]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of these pre-tokens, as text and as bytes."""
        kept, miss, ask = self.kept, [], []
        for word in words:
            if (rank := self.whole.get(raw := word.encode())) is not None:
                kept[word] = str(rank), rank.to_bytes(4, "little")
            else:
                miss.append(word)
                ask.append("".join(map(self.chars.__getitem__, raw)))
        for word, ids in zip(miss, self.model.encode(ask, out_type=int, num_threads=1) if ask else [], strict=True):
            kept[word] = ",".join(map(str, ids)), array("I", ids).tobytes()

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Per text: its decimal ids joined by commas, and the same ids as little-endian 32-bit words."""
        split = [self.pre_tokens(text) for text in texts]
        flat = list(chain.from_iterable(split))
        got = list(map(self.kept.get, flat))
        if gaps := [i for i, entry in enumerate(got) if entry is None]:
            self._learn(list(dict.fromkeys(flat[i] for i in gaps)))
            for i in gaps:
                got[i] = self.kept[flat[i]]
        if len(self.kept) > CACHE_ENTRIES:  # the entries that came first are the frequent ones
            self.kept = dict(islice(((k, v) for k, v in self.kept.items() if len(k) <= CACHED_BYTES), CACHE_ENTRIES // 2))
        at = 0
        for words in split:
            if words:
                decimal, raw = zip(*got[at : at + len(words)], strict=True)
                yield ",".join(decimal), b"".join(raw)
                at += len(words)
            else:
                yield "", b""

    def encode(self, text: str) -> list[int]:
        ids = next(self.encode_batch([text]))[1]
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.__getitem__, ids))


_held: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec in each Python worker."""
    if (path, pattern) not in _held:
        _held[path, pattern] = ByteBpe(path, pattern)
    return _held[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): every whole text's ids as little-endian unsigned 32-bit words. One pass, no shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                ids = [x[1] for x in bpe.encode_batch(texts[a:b].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col]).mapInArrow(common.trimmed(run), "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest of every document's ids and of the bytes they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                rows = []
                for decimal, ids in bpe.encode_batch(texts[a:b].to_pylist()):
                    n = len(ids) // 4
                    back = bpe.decode(struct.unpack(f"<{n}I", ids))
                    rows.append((n, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
                n, ids_sha, back_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
