"""Near-duplicate operators and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strataloom.llm import common, epsilon_grid, hyperminhash, paragraphs, passages

pytest.importorskip("public_tokenizers")
W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def root(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.p[max(a, b)] = min(a, b)


def shingles(text, size):
    w = W.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def labels_by_force(ids, sets, num, den):
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    u = Union(len(ids))
    for x, i in enumerate(order):
        for y in range(x):
            a, b = sets[i], sets[order[y]]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                u.join(x, y)
    return {ids[i]: ids[order[u.root(x)]] for x, i in enumerate(order)}


def near_texts(rnd, groups=12, size=60):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([2, 3, 8, size, 4 * size]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rnd.random() < 0.1 else " ".join(copy))
    return out


@pytest.mark.parametrize("block", [400, 7, 2])
def test_hyperminhash_components(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "BLOCK_BYTES", 5000 * block)
    monkeypatch.setattr(common, "FEW", 0 if block == 2 else common.FEW)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rnd = random.Random(block)
    texts = near_texts(rnd) + [None, "", "  ", "one", "one", "long " * 20_000]
    ids = rnd.sample(range(1000), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, texts[0])]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id bigint, text string, rep string, component_id string")
    got = hyperminhash.near_duplicates(frame, 3, 85, 100).collect()
    sets = [shingles(t, 3) for t in texts]
    want = labels_by_force(ids, sets, 85, 100)
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got if r.id is not None} == want
    assert {r.id: r.n_shingles for r in got if r.id is not None} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    assert [r.component_id for r in got if r.id is None] == [None]


def test_hyperminhash_repeated_rows_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "x y z w")], "id bigint, text string")
    assert sorted((r.id, r.component_id) for r in hyperminhash.near_duplicates(frame, 3, 85, 100).collect()) == [(1, 1), (1, 1), (2, 2)]
    assert hyperminhash.near_duplicates(frame.limit(0), 3, 85, 100).count() == 0


def test_hyperminhash_different_texts_of_one_id(spark):
    rnd = random.Random(44)
    a, b, c, d, e = (" ".join(fresh_words(rnd, 40)) for _ in range(5))
    # 5 holds a and b of one size: both keep their links; 7 holds c and d, which 1 and 2 hold as well
    rows = [(5, a), (5, b), (6, a + " more"), (8, b + " more"), (1, c), (2, d), (7, c), (7, d), (9, e)]
    got = {(r.id, r.component_id) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), 3, 85, 100).collect()}
    assert got == {(5, 5), (6, 5), (8, 5), (1, 1), (2, 1), (7, 1), (9, 9)}


def test_estimate_is_near_the_truth():
    rnd = np.random.default_rng(0)
    for n, j in ((50, 0.9), (400, 0.85), (3000, 0.5)):
        errors = []
        for _ in range(30):
            both = int(2 * n * j / (1 + j))
            pool = rnd.integers(0, 2**63, size=2 * n - both, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
            r = hyperminhash.sketch([a, b], 180)
            errors.append(float(hyperminhash.estimate(np.array((r[0] == r[1]).sum()), 180, np.array(n), np.array(n))) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03
    for t in (0.8, 0.85):
        rows, bands = hyperminhash.tune_bands(t)
        assert (1 - t**rows) ** bands <= hyperminhash.MISS


def test_hyperminhash_very_small_sets():
    rnd = np.random.default_rng(3)
    rows, bands = hyperminhash.tune_bands(0.85)
    for n in (6, 7, 8, 9, 10):  # of 8- to 12-word texts, against one word more
        big = [rnd.integers(0, 2**63, size=n + 1, dtype=np.uint64) for _ in range(4000)]
        a, b = (hyperminhash.sketch(sets, rows * bands) for sets in ([x[:-1] for x in big], big))
        assert (hyperminhash.band_keys(a, rows, bands) == hyperminhash.band_keys(b, rows, bands)).any(axis=1).all()
        assert abs((a == b).mean() - n / (n + 1)) < 0.005


def test_hyperminhash_one_word_appended(spark):
    rnd = random.Random(33)
    texts = []
    for n in range(8, 13):
        for _ in range(60):
            base = fresh_words(rnd, n)
            texts += [" ".join(base), " ".join([*base, *fresh_words(rnd, 1)])]
    ids = rnd.sample(range(10_000), len(texts))
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id bigint, text string")
    got = {r.id: r.component_id for r in hyperminhash.near_duplicates(frame, 3, 85, 100).collect()}
    assert got == labels_by_force(ids, [shingles(t, 3) for t in texts], 85, 100)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    u = Union(500)
    for a, b in edges:
        u.join(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component_id for r in common.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: u.root(x) for x in touched}


@pytest.mark.parametrize("block", [4096, 16])
def test_epsilon_grid(spark, monkeypatch, block):
    monkeypatch.setattr(epsilon_grid, "BLOCK", block)
    monkeypatch.setattr(epsilon_grid, "LEAF", 8)
    rnd = np.random.default_rng(block)
    centres = rnd.normal(size=(6, 12))
    x = np.concatenate([c + rnd.normal(size=(25, 12)) * s for c, s in zip(centres, (0.05, 0.2, 0.4, 0.5, 0.6, 1.0), strict=True)]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(500 + k, x[3].tolist()) for k in range(4)] + [(600, (x[5] * 1e30).tolist())]
    odd = [(700, None), (701, []), (702, [0.0] * 12), (703, [float("nan")] * 12), (704, [1.0, None] + [0.0] * 10), (705, [float("inf")] + [1.0] * 11), (706, [1.0, 2.0]), (707, [2.0, 4.0]), (None, x[3].tolist())]
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, *odd]], "id bigint, embedding array<float>, dim string")
    got = {r.id: r for r in epsilon_grid.near_vectors(frame, 0.9).collect()}
    unit = np.array([v for _, v in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    u = Union(len(rows))
    for a, b in zip(*np.nonzero(near), strict=True):
        u.join(int(a), int(b))
    assert [got[i].n_links for i, _ in rows] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i, _ in rows] == [rows[u.root(k)][0] for k in range(len(rows))]
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(700, 706))
    assert (got[706].n_links, got[707].component_id) == (1, 706) and got[None].component_id is None
    assert epsilon_grid.near_vectors(frame.limit(0), 0.9).count() == 0


def paragraph_rows(docs):
    out = []
    for i, t in docs:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            if len(W.findall(line)) >= paragraphs.LEAST_WORDS:
                out.append((i, k, at, at + len(line), shingles(line, 5)))
            at += len(line) + 1
    return out


def test_paragraphs(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 6)))
    fresh = lambda n: [word() for _ in range(n)]
    shared, docs = [fresh(60), fresh(45), fresh(200)], []
    for i in range(40):
        lines = [" ".join(fresh(rnd.choice([3, 41, 80]))) for _ in range(rnd.randint(0, 3))]
        for p in shared:
            if rnd.random() < 0.3:
                copy = list(p)
                if rnd.random() < 0.5:
                    copy[rnd.randrange(len(copy))] = word()
                lines.insert(rnd.randint(0, len(lines)), " ".join(copy))
        docs.append((i, "\n".join([*lines, "short shared line"])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, " ".join(shared[0])), (104, " ".join(fresh(30_000)))]
    frame = spark.createDataFrame([(i, t, "x", "y", 0, "clash", "clash") for i, t in docs] + [(None, " ".join(shared[0]), "x", "y", 0, "", "")], "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, id string")
    rows = paragraph_rows(docs)
    keys = [(r[0], r[1]) for r in rows]
    want = labels_by_force(keys, [r[4] for r in rows], 80, 100)
    size = Counter(want.values())
    found = paragraphs.repeats(frame).collect()
    assert {(r.doc_id, r.place): (r.component_doc_id, r.kept) for r in found} == {k: (c[0], k == c) for k, c in want.items() if size[c] > 1}
    spans = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    assert all((r.start, r.end) == spans[r.doc_id, r.place] for r in found)
    left = {r.doc_id: r.text for r in paragraphs.drop_repeats(frame).collect()}
    assert left.pop(None) == " ".join(shared[0])
    whole = {i: "\n".join(line for k, line in enumerate((t or "").split("\n")) if want.get((i, k), (i, k)) == (i, k)) for i, t in docs}
    check_passages({i: t or "" for i, t in docs}, whole, left)
    assert paragraphs.drop_repeats(frame.limit(0)).count() == 0


def check_passages(texts, whole, left):
    """left, against the texts without their repeated paragraphs: only runs that another document has are gone, and all long ones."""
    words = {i: W.findall(t.translate(LOWER)) for i, t in whole.items()}
    runs = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    holders = Counter(r for w in words.values() for r in set(runs(w, passages.RUN)))
    for i, w in words.items():
        covered = {k + j for k, r in enumerate(runs(w, passages.RUN)) if holders[r] > 1 for j in range(passages.RUN)}
        if not w:
            assert i not in left or left[i] in (None, texts[i])
            continue
        rest, k = W.findall((left.get(i) or "").translate(LOWER)), 0
        for x in rest:  # what is left is in order, and what was passed over was covered
            while w[k] != x:
                assert k in covered
                k += 1
            k += 1
        assert all(j in covered for j in range(k, len(w)))
        if not covered:
            assert left[i] == whole[i]
    long = Counter(r for t in left.values() for r in set(runs(W.findall((t or "").translate(LOWER)), 49)))
    assert not [r for r, n in long.items() if n > 1]


def test_passages_inside_paragraphs(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(3, 7)))
    fresh = lambda n: [word() for _ in range(n)]
    shared = [fresh(50), fresh(51), fresh(90), fresh(29)]
    docs = []
    for i in range(40):
        body = fresh(rnd.randint(60, 200))
        for n, p in enumerate(shared[i % 4 : i % 4 + 2]):
            at = len(body) if n else rnd.randint(0, len(body) - 5)
            body[at:at] = p
        docs.append((i, " ".join(body) + "\n" + " ".join(fresh(5))))
    docs += [(90, " ".join(["same"] * 400)), (91, " ".join(["same"] * 300)), (92, None), (93, " ".join(shared[0]))]
    frame = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    places = {(r.doc_id, r.place) for r in paragraphs.repeats(frame).collect() if not r.kept}
    whole = {i: "\n".join(line for k, line in enumerate((t or "").split("\n")) if (i, k) not in places) for i, t in docs}
    left = {r.doc_id: r.text for r in paragraphs.drop_repeats(frame).collect()}
    check_passages({i: t or "" for i, t in docs}, whole, left)
    assert len(W.findall(left.get(93) or "")) < 2 * passages.SPREAD and 0 in left
    assert all(not any(" ".join(p) in (left[i] or "") for p in shared[:3]) for i in range(4, 40))


def fresh_words(rnd, n):
    return ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(8, 12))) for _ in range(n)]


def words_left(spark, texts, passage):
    """Words of the passage in what is left of each text, each occurrence counted, and op7's passage rows."""
    frame = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: W.findall(r.text) for r in paragraphs.drop_repeats(frame).collect()}
    lists = paragraphs._passages(frame, paragraphs._listed(paragraphs.repeats(frame)))
    rows = sorted((r.doc_id, r.start, r.end, r.n_words, r.component_doc_id, r.kept) for r in paragraphs.spans(frame, lists).collect())
    return {i: sum(w in set(passage) for w in left.get(i, [])) for i in texts}, rows


@pytest.mark.parametrize("size", [60, 75, 100])
def test_passage_twice_in_a_later_document(spark, size):
    rnd = random.Random(size)
    p, fresh = fresh_words(rnd, size), lambda n: fresh_words(rnd, n)
    line = lambda: " ".join([*fresh(50), *p, *fresh(50)])
    wrapped = "\n".join(" ".join(p[i : i + 12]) for i in range(0, size, 12))
    texts = {1: line(), 2: line() + "\n" + line() + "\n" + wrapped + "\n" + line()}
    left, rows = words_left(spark, texts, p)
    assert left[1] == size and left[2] < 4 * 2 * passages.SPREAD
    gone = [r for r in rows if r[0] == 2]
    assert len(gone) == 4 and all(r[3] > size - 2 * passages.SPREAD and r[4:] == (1, False) for r in gone)
    assert all(r[3] == len(W.findall(texts[r[0]][r[1] : r[2]])) for r in rows)


@pytest.mark.parametrize("size", [51, 60, 75, 100])
def test_passage_nested_in_a_longer_one(spark, size):
    rnd = random.Random(size)
    p, x, y, fresh = fresh_words(rnd, size), fresh_words(rnd, 45), fresh_words(rnd, 45), lambda: fresh_words(rnd, 60)
    texts = {1: " ".join([*fresh(), *p, *fresh()]), 2: " ".join([*fresh(), *x, *p, *y, *fresh()]), 3: " ".join([*fresh(), *x, *p, *y, *fresh()])}
    left, rows = words_left(spark, texts, p)
    assert left[1] == size and left[2] < 2 * passages.SPREAD and left[3] == 0
    for part in (x, y):  # their first holder keeps them, but for what stands in a run that goes
        assert [n >= 45 - 2 * passages.SPREAD for n in words_left(spark, texts, part)[0].values()] == [False, True, False]
    assert all(r[3] == len(W.findall(texts[r[0]][r[1] : r[2]])) for r in rows)


def test_places_of_one_hash_that_overlap_are_one(spark):
    docs = spark.createDataFrame([(1, 1, " ".join(["same"] * 5000), None), (2, 1, " ".join(["same"] * 300), None)], "doc_id bigint, digest bigint, text string, gone array<bigint>")
    assert passages.fingerprints(docs).count() == 2
    assert sorted((r.doc_id, r.runs[0]["first"]) for r in passages.repeated(docs).collect()) == [(1, True), (2, False)]


def test_passage_twice_in_one_document(spark):
    rnd = random.Random(8)
    p, fresh = fresh_words(rnd, 80), lambda: " ".join(fresh_words(rnd, 60))
    text = "\n".join([fresh() + " " + " ".join(p) + " " + fresh(), fresh() + " " + " ".join(p) + " " + fresh()])
    left, rows = words_left(spark, {7: text}, p)
    assert 80 <= left[7] < 80 + 2 * passages.SPREAD
    assert [(r[0], r[5]) for r in rows] == [(7, True), (7, False)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("base", [0, 1 << 42, (1 << 62) + 5, -9])
def test_substring_dedup_keys_rows_not_ids(spark, base):
    rnd = random.Random(3)
    w, v = (" ".join(fresh_words(rnd, 60)) for _ in range(2))
    rows = [(base + 1, w), (base + 2, w + "\n" + v), (base + 2, v + "\nshort"), (base + 3, v), (base + 3, v), (None, w)]
    docs = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in rows], SCHEMA)
    left = sorted(((r.doc_id, r.text, r.n_chars) for r in paragraphs.drop_repeats(docs).collect()), key=str)
    kept = "\n".join(t for _, t, _ in left)
    assert w in kept and v in kept and "short" in kept  # nothing goes without a copy that stays
    assert sum(t.count(v) for i, t, _ in left) == 1 and sum(t.count(w) for i, t, _ in left if i is not None) == 1
    assert all(n == len(t) for _, t, n in left)


def test_substring_dedup_millions_of_lines(spark):
    rnd = random.Random(4)
    w = " ".join(fresh_words(rnd, 60))
    docs = spark.createDataFrame([(5, "a\n" * 5_000_000 + w, "", "", 0), (6, w + "\nend", "", "", 0), (4, w, "", "", 0)], SCHEMA)
    found = sorted((r.doc_id, r.start, r.end, r.component_doc_id, r.kept) for r in paragraphs.repeats(docs).collect())
    assert found == [(4, 0, len(w), 4, True), (5, 10_000_000, 10_000_000 + len(w), 4, False), (6, 0, len(w), 4, False)]
    left = {r.doc_id: r.text for r in paragraphs.drop_repeats(docs).collect()}
    assert left == {4: w, 5: "a\n" * 4_999_999 + "a", 6: "end"}


def test_substring_dedup_clashing_columns(spark):
    w = " ".join(fresh_words(random.Random(5), 60))
    names = ["gone", "cuts", "digest", "runs", "id", "node", "rep", "label", "cluster", "gone_", "cuts_", "digest_", "place", "start", "end", "h", "g", "component_id", "salt_hot", "n_hot"]
    docs = spark.createDataFrame([(i, w + f"\nline {i}", *names) for i in (3, 4, 5)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = paragraphs.drop_repeats(docs)
    assert got.columns == docs.columns
    rows = sorted(got.collect())
    assert [r.text for r in rows] == [w + "\nline 3", "line 4", "line 5"] and all(list(r)[2:] == names for r in rows)


def test_cut_text_by_force():
    rnd = random.Random(6)
    for _ in range(300):
        lines = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 6))]
        text, places = "\n".join(lines), sorted(rnd.sample(range(len(lines)), rnd.randint(0, len(lines) - 1)))
        ends = sorted(rnd.sample(range(len(text) + 1), 2 * min(2, (len(text) + 1) // 2)))
        cuts = [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b]
        want, at = [], 0
        for k, line in enumerate(lines):
            rest = "".join(c for i, c in enumerate(line, at) if not any(a <= i < b for a, b in cuts))
            if k not in places and (rest == line or rest.strip()):
                want.append(rest)
            at += len(line) + 1
        assert paragraphs.cut_text(text.encode(), places, iter(cuts)).decode() == "\n".join(want)


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_words_that_cancel_in_a_polynomial_differ(spark, n):
    from strataloom.llm.words import Words
    import pyarrow as pa

    a, b = thue_morse(n)
    words = Words(pa.array([a, b]))
    assert words.hashes[0] != words.hashes[1]
    docs = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} two"), (3, f"one {a} two")], "id bigint, text string")
    assert sorted((r.id, r.component_id) for r in hyperminhash.near_duplicates(docs, 3, 85, 100).collect()) == [(1, 1), (2, 2), (3, 1)]
    runs = [list(x.replace("a", "xx ").replace("b", "yyy ").split()) for x in (a, b)]
    long = Words(pa.array([" ".join(r) for r in runs]))
    h = long.windows(40)[0]
    assert len(set(h.tolist())) == len({tuple(r[i : i + 40]) for r in runs for i in range(len(r) - 39)})


@pytest.mark.parametrize("n", [3, 6, 7, 8, 9, 10, 12, 16, 24, 40, 90, 200])
def test_recall_of_bands_by_set_size(n):
    """Pairs of sets at or just above 0.85, of equal and of different sizes: at least 0.999 share a band."""
    rnd = np.random.default_rng(n)
    rows, bands = hyperminhash.tune_bands(0.85)
    missed = pairs = 0
    for extra_a in range(0, 1 + n // 12):
        for extra_b in range(1, n):
            both = n - extra_a
            if both <= 0 or both < 0.85 * (both + extra_a + extra_b):
                break
            if (extra_a, extra_b) not in {(0, 1), (1, 1), (0, 2)} and both >= 0.85 * (both + extra_a + extra_b + 1):
                continue
            pool = rnd.integers(0, 2**63, size=(2000, both + extra_a + extra_b), dtype=np.uint64)
            a = hyperminhash.sketch([x[: both + extra_a] for x in pool], rows * bands)
            b = hyperminhash.sketch([np.concatenate([x[:both], x[both + extra_a :]]) for x in pool], rows * bands)
            missed += (~(hyperminhash.band_keys(a, rows, bands) == hyperminhash.band_keys(b, rows, bands)).any(axis=1)).sum()
            pairs += len(pool)
    assert missed <= 0.001 * pairs


def test_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeioustn") for _ in range(rnd.randint(2, 8)))
    text = lambda: "\n".join(" ".join(word() for _ in range(rnd.randint(8, 60))).capitalize() + "." for _ in range(6))
    good = [text() for _ in range(60)]
    passage = " ".join(word() for _ in range(55)) + "."
    texts = good + good[:5] + [g + "\n" + passage for g in (text(), text())] + [g + "\nend password=abcdefgh123 ok." for g in (text(),)] + [" | ".join(word() for _ in range(90)) for _ in range(9)] + [None, "", "short"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    now = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, None)
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = common.durable(now)
        steps[name] = {r.doc_id: r for r in now.collect()} if name != "packing" else now.collect()
    ids = set(range(60)) | {65, 66, 67}
    assert set(steps["quality rules"]) == ids | set(range(60, 65)) and set(steps["minhash near-dedup"]) == ids
    after = steps["substring dedup"]
    assert set(after) == ids and after[65].text == texts[65] and after[66].text == texts[66].rsplit("\n", 1)[0] and all(after[i].text == texts[i] for i in range(60))
    assert steps["secret scans"][67].text.endswith("end [secret] ok.") and steps["secret scans"][0].text == texts[0]
    assert {r.doc_id for r in steps["packing"]} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), None).count() == 0


def test_pipeline_stages_keep_rows_and_columns(spark):
    """Columns that clash with the operators' own, ids beyond 2**41, a null id, rows that repeat, and two texts of one id."""
    import corpus_pipeline

    rnd = random.Random(17)
    text = lambda: "\n".join(" ".join("".join(rnd.choice("aeioustn") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(8, 20))).capitalize() + "." for _ in range(8))
    names = ["id", "node", "gone", "runs", "digest", "cuts", "component_id", "salt_hot", "row", "kept"]
    texts = [text() for _ in range(12)]
    big = (1 << 42) + 3
    rows = [(i, t) for i, t in enumerate(texts[:6])] + [(big, texts[6]), (big, texts[7]), (big, texts[6]), (None, texts[8]), (None, texts[8]), (40, texts[0]), (41, texts[0] + " tail")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *names) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.durable(stage(spark, docs, None))
        assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")], name
        assert all(list(r)[5:] == names for r in docs.collect())
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(left, key=str) == sorted([*enumerate(texts[:6]), (big, texts[6]), (big, texts[7]), (None, texts[8]), (None, texts[8])], key=str)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()} == {*range(6), big, None}
