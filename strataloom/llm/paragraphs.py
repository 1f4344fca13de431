"""Substring dedup: paragraphs that repeat, nearly or exactly, across or within documents.

Texts are cut at line feeds. Paragraphs of at least LEAST_WORDS words are the units; MinHash bands tuned for recall bring
them together, the exact Jaccard similarity of their five-word shingles verifies them, and of each component the first
paragraph stays, by doc_id, digest of the text and place. In what stays, passages that repeat inside other paragraphs or
across their ends are found by their exact words (passages.py) and go as well. Repeated lines and passages below these
lengths are no duplicates by the operator's definition: greetings and headings repeat in good texts. least_words sets
that length.

A paragraph is known by its doc_id, the digest of its text and its place, so different texts under one doc_id are
different documents. Defined results: rows of equal doc_id and text are one document, and all get what it gets; a null
text has no paragraphs; a document without an id is neither compared nor changed; paragraphs without a repeat give no
row; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hyperminhash, passages
from .words import Words, char_places

LEAST_WORDS = 40
SHINGLE, NUM, DEN = 5, 80, 100
#: Paragraphs are many and short: few registers, in short bands, keep the band table small at this chance of a miss.
MISS, MOST_REGISTERS = 1e-5, 96
KEY = ["doc_id", "digest", "place"]
_BLANK = b" \t\n\x0b\x0c\r"


def cut_paragraphs(batch: pa.RecordBatch, least_words: int = LEAST_WORDS) -> tuple[list[pa.Array], pa.Array]:
    """Of (doc_id, digest, text): doc_id, digest, place, start, end, n_words of the paragraphs that are compared, and their texts.

    start and end are in code points.
    """
    texts = batch.column(2)
    words = Words(texts, hashed=False)
    data = words.data
    first = np.zeros(len(data) + 1, dtype=bool)
    first[words.text_at] = True
    first[1:][data == 0x0A] = True  # a paragraph begins at a text and after a line feed
    first[-1] = False
    begin = np.flatnonzero(first)
    stop = np.append(begin[1:], len(data))
    n = np.searchsorted(words.starts, stop) - np.searchsorted(words.starts, begin)
    at = np.flatnonzero(n >= least_words)
    owner = np.searchsorted(words.text_at, begin, side="right") - 1
    place = np.arange(len(begin)) - np.searchsorted(owner, owner)
    chars = char_places(data)
    feed = (stop > begin) & (data[np.maximum(stop - 1, 0)] == 0x0A) if len(data) else np.zeros(len(begin), bool)
    end = stop - feed
    origin = chars[words.text_at[owner]]
    raw = memoryview(np.ascontiguousarray(data))
    parts = pa.array([bytes(raw[x:y]) for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
    rows = pa.array(owner[at])
    ints = [place[at], (chars[begin] - origin)[at], (chars[end] - origin)[at], n[at]]
    return [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(x.astype(np.int64)) for x in ints]], parts


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of the documents that have an id and a text."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, digest, place, start, end, n_words, component_doc_id, kept) of the paragraphs that have a repeat; durable."""
    start = common.mark()
    rows, bands = hyperminhash.tune_bands(NUM / DEN, MISS, MOST_REGISTERS)
    keyed = _keyed(docs)
    source = hyperminhash.Source(keyed, "doc_id bigint, digest bigint, place bigint, start bigint, end bigint, n_words bigint", lambda batch: cut_paragraphs(batch, least_words))
    sk = common.durable(source.sketches(SHINGLE, rows, bands).withColumn("id", F.monotonically_increasing_id()))

    def sets(nodes: DataFrame, classes: DataFrame) -> DataFrame:
        held = common.durable(sk.select("id", *KEY).join(nodes.select(F.col("node").alias("id")), "id", "left_semi"))
        some = common.rows_of(keyed, "doc_id", common.durable(held.select("doc_id").distinct()))
        made = source.sets(some, SHINGLE, rows * bands).select(*KEY, "registers", "shingles")
        few = F.broadcast(held) if held.count() <= common.BROADCAST_IDS // 4 else held
        return made.join(few, KEY).groupBy(F.col("id").alias("node")).agg(F.first("registers").alias("registers"), F.first("shingles").alias("shingles"))

    found = common.durable(hyperminhash.near_rows(sk, sets, NUM, DEN).select(*KEY, "start", "end", "n_words", "component_id").distinct())
    first = common.durable(found.groupBy("component_id").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = common.join_each(found, first.select("component_id", "first"), ["component_id"], "digest", found.count(), counts=first.select("component_id", "n"))
    out = common.durable(met.select(*KEY, "start", "end", "n_words", F.col("first.doc_id").alias("component_doc_id"), (F.struct(*KEY) == F.col("first")).alias("kept")))
    common.drop_scratch(start, keep=(out,))
    return out


def _listed(found: DataFrame) -> DataFrame:
    """(doc_id, digest, gone): places of the paragraphs that go, durable."""
    gone = found.where("not kept").groupBy("doc_id", "digest")
    return common.durable(gone.agg(F.array_sort(F.collect_set("place")).alias("gone")))  # one document's paragraphs


def _parts(docs: DataFrame, lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of docs that have a row of durable lists, joined with it, and the others. Texts of the others aren't shuffled below the bound."""
    ids = lists.select("doc_id").distinct()
    few = F.broadcast(ids) if lists.count() <= common.BROADCAST_IDS else ids
    return docs.join(few, "doc_id", "left_semi").join(lists, keys, "left"), docs.join(few, "doc_id", "left_anti")


def _passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, digest, gone, runs): what goes, and the repeated runs, of every document with either; durable. gone is durable."""
    some, rest = _parts(_keyed(docs), gone, ["doc_id", "digest"])
    masked = some.unionByName(rest.withColumn("gone", F.lit(None).cast("array<bigint>")))
    return common.durable(gone.join(passages.repeated(masked), ["doc_id", "digest"], "full_outer"))


def _runs(rows) -> list[tuple[int, int, int, bool]]:
    return [(r["word"], r["words"], r["lead_id"], r["first"]) for r in rows or ()]


def spans(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words, component_doc_id, kept) of every repeated passage of lists, which is durable."""

    def run(batches):
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                part = texts[a:b]
                words = Words(passages.blanked(part, batch.column(2)[a:b].to_pylist()), hashed=False)
                chars = char_places(Words(part, hashed=False).data)
                rows = []
                for k, (doc_id, runs) in enumerate(zip(batch.column(0)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist(), strict=True)):
                    at, base = words.word_at[k], chars[words.text_at[k]]
                    for kept, found in zip((True, False), passages.merged(_runs(runs)), strict=True):
                        rows += [(doc_id, chars[words.starts[at + x]] - base, chars[words.ends[at + y - 1]] - base, y - x, lead, kept) for x, y, lead in found]
                if rows:
                    *ints, kept = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in ints], pa.array(kept)], ["doc_id", "start", "end", "n_words", "component_doc_id", "kept"])

    some = _parts(_keyed(docs), lists.where("runs is not null"), ["doc_id", "digest"])[0]
    once = some.where("runs is not null").select("doc_id", "text", "gone", "runs")
    return once.mapInArrow(common.trimmed(run), "doc_id bigint, start bigint, end bigint, n_words bigint, component_doc_id bigint, kept boolean").distinct()


def cut_text(text: bytes, places: list[int], cuts: Iterator[tuple[int, int]]) -> bytes:
    """The text without the lines at these places and the bytes in these spans, both in order; lines that were cut to nothing go."""
    out, at, cut, gone = [], 0, next(cuts, None), iter(places)
    skip = next(gone, -1)
    for place, line in enumerate(text.split(b"\n")):
        end = at + len(line)
        if place == skip:
            skip = next(gone, -1)
        else:
            parts, here = [], at
            while cut is not None and cut[0] < end:
                if cut[1] > here:
                    parts.append(text[here : max(cut[0], here)])
                    here = max(here, min(cut[1], end))
                if cut[1] > end:
                    break
                cut = next(cuts, None)
            left = b"".join(parts) + text[here:end]
            if left == line or left.strip(_BLANK):
                out.append(left)
        while cut is not None and cut[1] <= end:
            cut = next(cuts, None)
        at = end + 1
    return b"\n".join(out)


def drop_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without what repeats an earlier paragraph or passage; documents that were nothing else go.

    All columns stay, whatever their names; n_chars follows the text.
    """
    start = common.mark()
    lists = _passages(docs, _listed(repeats(docs, least_words)))
    lists = lists.where(F.expr("gone is not null or exists(runs, r -> not r.first)"))
    columns = docs.columns
    at, named = columns.index("text"), {c: common.fresh(c, columns) for c in ("digest", "gone", "runs", "id", "text")}
    lists = common.durable(lists.select(F.col("doc_id").alias(named["id"]), F.col("digest").alias(named["digest"]), F.col("gone").alias(named["gone"]), F.col("runs").alias(named["runs"])))
    common.drop_scratch(start, keep=(lists,))
    ids = lists.select(F.col(named["id"]).alias("doc_id")).distinct()
    few = F.broadcast(ids) if lists.count() <= common.BROADCAST_IDS else ids
    some, rest = docs.join(few, "doc_id", "left_semi"), docs.join(few, "doc_id", "left_anti")
    some = some.withColumn(named["text"], F.xxhash64("text"))
    some = some.join(lists, (F.col("doc_id") == F.col(named["id"])) & (F.col(named["text"]) == F.col(named["digest"])), "left")

    def run(batches):
        for batch in batches:
            texts, gone, runs = common.text_column(batch.column(at)), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()
            old = batch.column(at).to_pylist()
            for a, b in common.chunks(texts):
                part = texts[a:b]
                words, new = Words(passages.blanked(part, gone[a:b]), hashed=False), []
                for k, text in enumerate(part.cast(pa.binary()).to_pylist()):
                    first, base = words.word_at[k], words.text_at[k]
                    cuts = ((int(words.starts[first + x] - base), int(words.ends[first + y - 1] - base)) for x, y, _ in passages.merged(_runs(runs[a + k]))[1])
                    listed = gone[a + k] or runs[a + k]
                    new.append(old[a + k] if not listed else cut_text(text, gone[a + k] or [], cuts).decode())
                changed = [x is not None and x != y for x, y in zip(new, old[a:b], strict=True)]
                stays = pa.array([not c or bool(x.strip(" \t\n\x0b\x0c\r")) for x, c in zip(new, changed, strict=True)])
                arrays = [pa.array(new, batch.column(i).type) if i == at else batch.column(i)[a:b] for i in range(len(columns))]
                if "n_chars" in columns:
                    i = columns.index("n_chars")
                    arrays[i] = pa.array([len(x) if c else n for x, c, n in zip(new, changed, batch.column(i)[a:b].to_pylist(), strict=True)], batch.column(i).type)
                yield pa.RecordBatch.from_arrays(arrays, columns).filter(stays)

    put = some.select(*common.quoted(columns), named["gone"], named["runs"])
    return put.mapInArrow(common.trimmed(run), docs.schema).unionByName(rest.select(*common.quoted(columns)))


def op7_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paragraph or passage with a repeat: where it is, the document that holds its first, whether it stays."""
    docs = common.documents(spark, sf_dir)
    found = repeats(docs)
    lists = _passages(docs, _listed(found))
    whole = found.select(F.lit("paragraph").alias("kind"), "doc_id", "start", "end", "n_words", "component_doc_id", "kept")
    return whole.unionByName(spans(docs, lists).select(F.lit("passage").alias("kind"), "doc_id", "start", "end", "n_words", "component_doc_id", "kept"))
