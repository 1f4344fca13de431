"""Packing by cutting-stock column generation.

A document's ids are cut into whole sequences and one remainder. The remainders' lengths, in units, form a histogram of
bounded size; a linear program over patterns (multisets of lengths that fit one sequence) is solved by column
generation, with an unbounded knapsack over the dual prices as the pricing step. Patterns are rounded down, what is
left of the histogram goes by best fit, and the patterns' slots are dealt to the documents by their rank among those of
the same length.

Defined results: a null text has the closing id alone; rows may repeat and are packed each; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import _LOW, U64, Words

CAPACITY = 2048
END_ID = 1
#: Lengths are rounded up to this many tokens in the histogram and the patterns.
UNIT = 8
#: Pieces of one length that a share of them ranks, at least and at most; between them it is a partition's part of all.
LEAST_RANKED, RANKED = 200, 200_000
#: The linear program ends within this share of its bound.
GAP = 2e-4
#: Runs whose ids a worker keeps, about 40 bytes each.
CACHE_ENTRIES = 500_000


class Runs:
    """Spans of bytes: hashes, first and last eight bytes and lengths; what is longer than those is compared as bytes."""

    def __init__(self, words: Words, starts: np.ndarray, ends: np.ndarray):
        self.words, self.starts, self.ends = words, starts, ends
        self.hashes, self.lengths = words.hash_spans(starts, ends), ends - starts
        self.heads = words.blocks(starts) & _LOW[np.minimum(self.lengths, 8)]
        self.tails = np.where(self.lengths > 8, words.blocks(np.maximum(ends - 8, 0)), U64(0))

    def raw(self, at: np.ndarray) -> list[bytes]:
        data = memoryview(np.ascontiguousarray(self.words.data))
        return [bytes(data[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class IdTable:
    """Ids by their run, in open addressing by its hash: looked up for many runs at a time, and a hit is one of equal bytes.

    The runs that came first are the frequent ones; when the table is full, the first half stays.
    """

    def __init__(self, entries: int):
        self.entries, self.mask = entries, U64((1 << (2 * entries - 1).bit_length()) - 1)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        self.n, self.used = 0, 0
        self.keys, self.heads, self.tails = (np.zeros(self.entries, U64) for _ in range(3))
        self.sizes, self.starts, self.lengths = (np.zeros(self.entries, np.int64) for _ in range(3))
        self.long: dict[int, bytes] = {}  # by entry: runs of more than 16 bytes
        self.pool = np.zeros(2 * self.entries, "<u4")

    def _same(self, entry: np.ndarray, runs: Runs, at: np.ndarray) -> np.ndarray:
        out = (self.heads[entry] == runs.heads[at]) & (self.tails[entry] == runs.tails[at]) & (self.sizes[entry] == runs.lengths[at])
        long = np.flatnonzero(out & (runs.lengths[at] > 16))
        if len(long):
            out[long] = [self.long[e] == raw for e, raw in zip(entry[long].tolist(), runs.raw(at[long]), strict=True)]
        return out

    def find(self, runs: Runs, which: np.ndarray) -> np.ndarray:
        """The entry of each of these runs, or -1."""
        out = np.full(len(which), -1, dtype=np.int64)
        at, todo = (runs.hashes[which] & self.mask).astype(np.int64), np.arange(len(which))
        while len(todo):
            entry = self.slots[at]
            some = entry >= 0
            hit = some.copy()
            here = which[todo[some]]
            hit[some] = (self.keys[entry[some]] == runs.hashes[here]) & self._same(entry[some], runs, here)
            out[todo[hit]] = entry[hit]
            go = some & ~hit
            todo, at = todo[go], at[go] + 1 & int(self.mask)
        return out

    def add(self, runs: Runs, new: np.ndarray, ids: list[bytes]) -> bool:
        """The runs at `new`, of distinct hashes, with their ids; of more than half the table's entries, the first.

        True if every run that had an entry still has the same one.
        """
        whole = len(new) <= self.entries // 2
        new, ids = new[: self.entries // 2], ids[: self.entries // 2]
        same = self.n + len(new) <= self.entries
        if not same:
            half = min(self.entries // 2, self.n)
            held = [x[:half].copy() for x in (self.keys, self.heads, self.tails, self.sizes, self.starts, self.lengths)]
            used, pool, long = int(held[4][-1] + held[5][-1]) if half else 0, self.pool, {e: raw for e, raw in self.long.items() if e < half}
            self._clear()
            self._place(held[0])
            for x, y in zip((self.heads, self.tails, self.sizes, self.starts, self.lengths), held[1:], strict=True):
                x[:half] = y
            self.pool, self.used, self.long = pool, used, long
        base, lengths = self.n, np.array([len(x) // 4 for x in ids], dtype=np.int64)
        self._place(runs.hashes[new])
        to = self.n
        self.heads[base:to], self.tails[base:to], self.sizes[base:to] = runs.heads[new], runs.tails[new], runs.lengths[new]
        long = np.flatnonzero(runs.lengths[new] > 16)
        self.long.update(zip((base + long).tolist(), runs.raw(new[long]), strict=True))
        body = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(body) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(body), "<u4")])
        self.pool[self.used : self.used + len(body)] = body
        self.starts[base:to], self.lengths[base:to] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(body)
        return same and whole

    def _place(self, hashes: np.ndarray) -> None:
        base = self.n
        self.n += len(hashes)
        self.keys[base : self.n] = hashes
        at, todo = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = base + todo[free]  # of those that meet in a slot, one stays
            go = self.slots[at] != base + todo
            todo, at = todo[go], at[go] + 1 & int(self.mask)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these entries, one after the other, and where each entry's begin."""
        lengths = self.lengths[entries]
        begins = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[np.repeat(self.starts[entries] - begins[:-1], lengths) + np.arange(begins[-1])], begins


class WordTokens:
    """A tokenizer that drops white space, applied to the runs between white space and kept by them.

    No match of its pre-tokenizer holds white space and no normal form joins what white space divides, so the ids of
    a text are those of its runs, one after the other. Its normaliser lower-cases, so runs may come in lower case, but
    for the special tokens' marks. A full stop or comma after a letter is a match of its own.
    """

    def __init__(self, path: str):
        self.model = tokenizers.Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.closes = np.zeros(1 + max(vocab.values()), dtype=bool)  # by id: it ends a match
        self.closes[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.table = IdTable(CACHE_ENTRIES)

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters, in one string: each is one match, unless lower case gives it marks that are no letters."""
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return [self.encode_whole(word) for word in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, held: Runs, new: np.ndarray) -> bool:
        runs, plain, other = held.raw(new), [], []
        for i, run in enumerate(runs):
            (plain if run.isalpha() or run.decode().isalpha() else other).append(i)
        found: list[bytes] = [b""] * len(runs)
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            for i, ids in zip(part, self._encode_words([runs[i].decode() for i in part]), strict=True):
                found[i] = ids
        for a in range(0, len(other), 2000):
            part = other[a : a + 2000]
            for i, got in zip(part, self.model.encode_batch_fast([runs[i].decode() for i in part], add_special_tokens=False), strict=True):
                found[i] = array("I", got.ids).tobytes()
        return self.table.add(held, new, found)

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Per text: its ids as little-endian unsigned 32-bit words."""
        words = Words(texts, lower=True, hashed=False)
        data, starts, ends = words.data, words.starts, words.ends
        last, before, lead = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
        letter = (ends - starts >= 2) & (before >= 0x61) & (before <= 0x7A) | (ends - starts >= 3) & (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut = ((last == 0x2E) | (last == 0x2C)) & letter
        of = np.repeat(np.arange(len(starts)), 1 + cut)
        second = np.zeros(len(of), dtype=bool)
        second[1:] = of[1:] == of[:-1]
        run_starts = np.where(second, ends[of] - 1, starts[of])
        run_ends = ends[of] - (cut[of] & ~second)
        runs = Runs(words, run_starts, run_ends)
        every = np.arange(len(of))
        entries = self.table.find(runs, every)
        gaps = np.flatnonzero(entries < 0)
        if len(gaps):
            _, first = np.unique(runs.hashes[gaps], return_index=True)
            if self._learn(runs, np.sort(gaps[first])):  # in the order of the text
                entries[gaps] = self.table.find(runs, gaps)
            else:  # the table has been thinned out
                entries = self.table.find(runs, every)
            if (entries < 0).any():  # then once more for what has just gone, or has the hash of another run
                return [x for k in range(len(texts)) for x in self.encode_batch(texts[k : k + 1])] if len(texts) > 1 else [self.encode_whole(texts[0].as_py())]
        ids, begins = self.table.gather(entries)
        at = begins[np.searchsorted(of, words.word_at)]
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if b"<|" in data.tobytes():
            for k, text in enumerate(texts.to_pylist()):
                if "<|" in text:
                    out[k] = self.encode_whole(text)
        return out


_held: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _held:
        _held[path] = WordTokens(path)
    return _held[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary): the whole text's ids and the closing id, as little-endian unsigned 32-bit words."""
    common.small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        model = word_tokens(path)
        for batch in batches:
            texts = common.text_column(batch.column(1))
            for a, b in common.chunks(texts):
                ids = [x + end for x in model.encode_batch(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id bigint, ids binary")


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces first, then the remainder. Ids are read off and let go."""
    common.small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        model = word_tokens(path)
        for batch in batches:
            texts, doc_ids = common.text_column(batch.column(1)), batch.column(0).to_pylist()
            for a, b in common.chunks(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], model.encode_batch(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(common.trimmed(run), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


# ---- the linear program, on the histogram -----------------------------------------------------------


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best unbounded knapsack of items of weight 1.. with these values: its value and the counts by weight."""
    weights = np.flatnonzero(values > 1e-12) + 1
    worth = values[weights - 1]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(weights, room, side="right"))
        best[room] = best[room - 1]
        if k:
            sums = best[room - weights[:k]] + worth[:k]
            at = int(sums.argmax())
            if sums[at] > best[room] + 1e-15:
                best[room], took[room] = sums[at], weights[at]
    counts, room = np.zeros(len(values), dtype=np.int64), capacity
    while room > 0:
        if took[room]:
            counts[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts by weight) and their shares in a basic solution of min sum x, A x >= demand, x >= 0."""
    items = np.flatnonzero(demand > 0)
    m = len(items)
    if not m:
        return []
    columns = np.zeros((m, m), dtype=np.int64)
    columns[np.arange(m), np.arange(m)] = capacity // (items + 1)
    inverse = np.diag(1.0 / columns.diagonal())
    x = demand[items] / columns.diagonal()
    bound = 0.0
    for _ in range(50 * m):
        dual = np.maximum(inverse.sum(axis=0), 0)
        values = np.zeros(len(demand))
        values[items] = dual
        value, counts = price(values, capacity)
        total = float(x.sum())
        bound = max(bound, float((dual * demand[items]).sum()) / max(value, 1.0))
        if value <= 1 + 1e-9 or total <= bound * (1 + gap):
            break
        enter = counts[items].astype(float)
        change = np.einsum("ij,j->i", inverse, enter)  # no threads of a linear algebra library beside the JVM's
        ratio = np.where(change > 1e-9, np.maximum(x, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x = np.maximum(x - theta * change, 0)
        x[out] = theta
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        columns[:, out] = counts[items]
    patterns = []
    for k in range(m):
        if x[k] > 1e-9:
            full = np.zeros(len(demand), dtype=np.int64)
            full[items] = columns[:, k]
            patterns.append((full, float(x[k])))
    return patterns


def plan_patterns(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold each item exactly once: rounded-down columns, then best fit for the rest.

    The work grows with the number of lengths; the rest has at most one sequence's items for each column, whatever
    the number of documents.
    """
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for counts, share in column_generation(demand, capacity, gap):
        n = int(np.floor(share + 1e-9))
        held = counts > 0
        if held.any():
            n = min(n, int((left[held] // counts[held]).min()))
        if n > 0:
            plan.append((counts, n))
            left -= n * counts
    while left.any():  # each round fills one sequence from the largest down, and repeats it while the rest allows
        counts, room = np.zeros(len(demand), dtype=np.int64), capacity
        while room > 0 and (fits := np.flatnonzero(left[:room] > counts[:room])).size:
            counts[fits[-1]] += 1
            room -= int(fits[-1]) + 1
        held = counts > 0
        n = int((left[held] // counts[held]).min())
        plan.append((counts, n))
        left -= n * counts
    return plan


def slot_table(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By item: the ranks at which each pattern's share of it begins, copies in a sequence, first sequence, first slot."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for counts, n in plan:
        slot = 0
        for item in np.flatnonzero(counts)[::-1]:
            copies = int(counts[item])
            table.setdefault(int(item), []).append((taken.get(int(item), 0), copies, base, slot))
            taken[int(item)] = taken.get(int(item), 0) + copies * n
            slot += copies
        base += n
    return {item: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for item, rows in table.items()}


# ---- dealing the slots ------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """pieces and the sequence and offset of each.

    Rows may repeat: a row number, made durable with the pieces, deals them. The driver gets the histogram, of capacity / unit rows at most, and
    a count for each share of a length: a share for every partition and length, and one for every RANKED pieces, at most.
    Ranks are two-level: within a share of a length by a window, and over
    the shares by their counts.
    """
    slots = capacity // unit
    kind = F.ceil(F.col("length") / unit).cast("int")
    spark = pieces.sparkSession
    ranked = common.durable(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("row"))).withColumn("kind", kind)
    lengths = ranked.groupBy("kind").agg(F.count("*").alias("n")).collect()
    part = sum(r.n for r in lengths) // int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(RANKED, max(LEAST_RANKED, part))
    shares = spark.createDataFrame([(r.kind, 1 + (r.n - 1) // most) for r in lengths], "kind int, shares bigint")
    ranked = ranked.join(F.broadcast(shares), "kind").withColumn("salt", F.pmod(F.xxhash64("row"), "shares"))
    counts = ranked.groupBy("kind", "salt").agg(F.count("*").alias("n")).collect()
    demand, before = np.zeros(slots, dtype=np.int64), {}
    for row in sorted(counts, key=lambda r: (r.kind, r.salt)):
        before.setdefault(row.kind, {})[row.salt] = int(demand[row.kind - 1])
        demand[row.kind - 1] += row.n
    table = slot_table(plan_patterns(demand, slots))
    within = Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "row")
    ranked = ranked.withColumn("rank", F.row_number().over(within).cast("bigint"))

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name in ("kind", "salt", "rank")}
            kinds, salts, ranks = col["kind"].astype(np.int64), col["salt"].astype(np.int64), col["rank"].astype(np.int64) - 1
            ranks += [before[k][share] for k, share in zip(kinds.tolist(), salts.tolist(), strict=True)]
            sequence, slot = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                begins, copies, base, lowest = table[int(k) - 1]
                which = np.searchsorted(begins, ranks[at], side="right") - 1
                inside = ranks[at] - begins[which]
                sequence[at] = base[which] + inside // copies[which]
                slot[at] = lowest[which] + inside % copies[which]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    dealt = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "salt", "rank").mapInArrow(common.trimmed(deal), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has at most `capacity` pieces
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("slot")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut_pieces(docs, path, capacity), capacity)


def sequences(encoded: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, little-endian 32-bit), doc_ids. doc_id must be a key of encoded."""
    held = packed.join(encoded, "doc_id").select("sequence_id", "offset", "doc_id", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("part"))
    rows = held.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "part"))).alias("p"))  # one sequence's pieces
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.part))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
