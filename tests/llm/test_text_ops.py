"""Formatting, tokenising, packing, secrets, quality and licences against plain definitions, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import byte_bpe, chat, common, licences, packing, quality, secrets, toxicity
from strataloom.llm.words import Words

P = pytest.importorskip("public_tokenizers")
W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, row string"


def rows_of(texts):
    return [(i, t, None, f"s{i % 3}" if i % 5 else None, None, "clash", "clash") for i, t in enumerate(texts)]


AWKWARD = [None, "", " \n\t ", "one", "two words", "same line\nsame line\nsame line", "é漢字 　 İ. <|endoftext|> \\x", "x" * 50_000, "a b c " * 3000, "tail \n", "tail \n"]


def docs(spark, texts=AWKWARD, extra=()):
    return spark.createDataFrame([*rows_of(texts), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    words = Words(pa.array(texts), lower=True)
    assert [len(W.findall(t)) for t in texts] == words.counts().tolist()
    for size in (2, 3):
        sets = words.shingles(size)
        plain = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()) for w in map(W.findall, texts)]
        assert [len(s) for s in plain] == [len(s) for s in sets]
        for a in range(0, 200, 7):
            for b in range(0, 200, 11):
                assert len(plain[a] & plain[b]) == len(np.intersect1d(sets[a], sets[b]))


def test_chunks_cover_all_rows():
    texts = pa.array(["", "a" * 10, "b" * 3, "", "c" * 99, ""])
    ranges = list(common.chunks(texts, 12))
    assert [a for a, _ in ranges][1:] == [b for _, b in ranges][:-1] and ranges[0][0] == 0 and ranges[-1][1] == 6


# ---- op1 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(20))
def test_chat_escapes_round_trip(seed):
    rnd = random.Random(seed)
    marks = ["\\", "<", "/", "turn", ">", "</turn>", '<turn role="x">\n', "\n", "<image 0>", "### Assistant:", "\\<", "é"]
    for _ in range(100):
        text, role = "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 12))), rnd.choice(['a"b\\', "user", ""])
        segment, a, b, _, _ = chat.format_message(role, [{"type": "text", "text": text}])
        assert chat.read_segment(segment) == (role, text)
        assert chat.unescape(segment[a:b]) == text and segment.count(chat.CLOSE) == 1


def test_chat_parts():
    content = [{"type": "text", "text": "see <image 0> "}, {"type": "image", "ref": "i.png", "width": 600, "height": 500}, {"type": "document", "ref": "d.pdf", "pages": 2, "parts": [{"type": "text", "text": "in"}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}]}]
    segment, _, _, attached, tokens = chat.format_message("user", content)
    assert segment == '<turn role="user">\nsee \\<image 0> <image 0><document 1>in<audio 2>\n</turn>\n'
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in attached] == [(0, "image", "i.png", 85 + 340), (1, "document", "d.pdf", 1200), (2, "audio", "a.wav", 38)]
    assert tokens == 425 + 1200 + 38
    segment, _, _, attached, tokens = chat.format_message("user", [{"type": "video", "ref": "v"}, {"type": None}, {"type": "text", "text": "<other 0>"}])
    assert segment == '<turn role="user">\n<other 0><other 1>\\<other 0>\n</turn>\n' and tokens == 0
    assert [(a["kind"], a["ref"]) for a in attached] == [("other", "v"), ("other", None)]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (1, 1, "assistant", "b</turn>"), (2, None, None, "x"), (None, 3, "user", "n"), (3, 0, "assistant", "")]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", chat.text_content(F.coalesce("text", F.lit(""))).alias("content"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb</turn>\nassistant\nb</turn>\n")
    assert got[1].loss_chars == 16 and got[1].loss_sha256 == sha("b</turn>" * 2)
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].n_turns == 1 and got[3].loss_sha256 == sha("")
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


# ---- op4 and op8 ------------------------------------------------------------------------------------


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBpe(path, P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={w: i for i, w in enumerate(bpe.ranks)}, special_tokens={})
    rnd = random.Random(1)
    for _ in range(2000):
        text = "".join(rnd.choice("ab éß\n\t 　\x1c\x85 1²٣'stll,.!🤦‍ñ漢字か") for _ in range(rnd.randint(0, 40)))
        ids = bpe.encode(text)
        assert ids == plain.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    got = sorted(byte_bpe.round_trip(docs(spark), path, P.PATTERN).collect())
    for r, text in zip(got, AWKWARD, strict=True):
        ids = plain.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty(spark), path, P.PATTERN).count() == 0
    assert byte_bpe.encode_documents(docs(spark), path, P.PATTERN).count() == len(AWKWARD)


def test_word_tokens_survive_a_small_table(monkeypatch):
    import tokenizers

    monkeypatch.setattr(packing, "CACHE_ENTRIES", 40)
    own, plain = packing.WordTokens(P.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab cdé\n.,'sß漢İ<|endoftext|>×") for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [t or "" for t in AWKWARD]
    for a in range(0, len(texts), 25):
        for text, ids in zip(texts[a : a + 25], own.encode_batch(pa.array(texts[a : a + 25])), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_word_tokens_of_runs_with_one_hash(monkeypatch):
    import tokenizers

    monkeypatch.setattr(Words, "hash_spans", lambda self, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    own, plain = packing.WordTokens(P.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["one two six ten", "abcabcabcabcabcabcabc abcabcabcabcabdabcabc one", "six two", "", "a b c one. two, end"] * 2
    for text, ids in zip(texts, own.encode_batch(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(rows, lengths, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == lengths
    for pieces in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for begin, n in sorted(pieces):
            assert begin == at and n > 0
            at += n
    assert all(sum(n for _, n in p) <= capacity for p in by_sequence.values())
    return len(by_sequence)


def test_packing_whole(spark):
    import tokenizers

    path, plain = P.path("word_bpe_49k.json"), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    texts = AWKWARD + [" ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 900))) for _ in range(150)]
    rows = packing.pack_documents(docs(spark, texts), path).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    n = check_packing(rows, {i: len(x) for i, x in ids.items()}, 2048)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    total = sum(map(len, ids.values()))
    assert n * 2048 - total < 0.03 * total + 2048
    encoded = packing.encode_documents(docs(spark, texts), path)
    whole = packing.sequences(encoded, spark.createDataFrame(rows)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == total
    assert packing.pack_documents(empty(spark), path).count() == 0
    again = packing.pack_documents(docs(spark, ["a b"] * 3).unionByName(docs(spark, ["a b"] * 3)), path).collect()
    assert len(again) == 6 and len({(r.sequence_id, r.offset) for r in again}) == 6


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_each_item_once(seed):
    rnd = np.random.default_rng(seed)
    capacity = 64
    demand = np.bincount(rnd.integers(0, capacity, size=int(rnd.integers(1, 3000))), minlength=capacity)
    plan = packing.plan_patterns(demand, capacity)
    assert (sum(n * counts for counts, n in plan) == demand).all()
    assert all((counts * np.arange(1, capacity + 1)).sum() <= capacity for counts, _ in plan)
    used, least = sum(n for _, n in plan), int((demand * np.arange(1, capacity + 1)).sum() / capacity)
    big = int(demand[capacity // 2 :].sum())  # no two of these share a sequence
    assert used <= max(least, big) * 1.25 + len(plan)


# ---- op5 --------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark):
    rnd = random.Random(4)
    bits = ["password=", "secret: token:abcdefgh1", "Token = '", "api_key:", "apikey=short", "AKIA" + "B2" * 8, "AKIAAKIA", "0123456789abcdef" * 2, "é漢", "\n", " ", "deadbeef", "=", "Zz09+/_.-x", "ſecret=abcdefgh12"]
    texts = AWKWARD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(120)]
    wide, own = "ghp_" + "a1B2" * 6, "ghp_" + "c3D4" * 6
    extra = [(900 + k, f"x {wide} y", None, f"owner{k}", None, "", "") for k in range(6)] + [(990, f"x {own} y", None, "solo", None, "", "")]
    frame = docs(spark, texts, extra)
    got = {r.doc_id: r for r in secrets.report(secrets.candidates(frame)).collect()}
    names = ("assign", "access", "hex")
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans == joined
    assert all(got[900 + k].spans == "" and got[900 + k].n_example == 1 for k in range(6))
    assert got[990].spans == "provider:2:30" and got[990].n_live == 1
    clean = {r.doc_id: r for r in secrets.redact(frame).collect()}
    assert len(clean) == len(got) and clean[990].text == "x [secret] y" and clean[900].text == f"x {wide} y" and clean[0].text is None
    for i, t in enumerate(texts):
        assert not base_spans(t or "") or clean[i].text != t
        assert base_spans(t or "") or clean[i].text == t
    assert secrets.report(secrets.candidates(empty(spark))).count() == 0 and secrets.redact(empty(spark)).count() == 0


# ---- op6 --------------------------------------------------------------------------------------------


def plain_counts(t):
    words, seen, repeated = W.findall(t), set(), 0
    for line in t.split("\n"):
        if W.search(line):
            repeated += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marks = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(marks)]


def test_quality(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioustn") for _ in range(rnd.randint(2, 8)))
    good = ["\n".join(" ".join(word() for _ in range(rnd.randint(8, 20))).capitalize() + "." for _ in range(8)) for _ in range(160)]
    bad = [" | ".join(word() for _ in range(90)) for _ in range(25)] + [" ".join(word() + rnd.choice(["%%%", "###"]) for _ in range(90)) for _ in range(15)]
    texts = AWKWARD + good + bad
    got = sorted(quality.score(docs(spark, texts)).collect())
    for r, t in zip(got, texts, strict=True):
        counts = plain_counts(t or "")
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)
    a = len(AWKWARD)
    assert all(r.kept for r in got[a : a + len(good)]) and not any(r.kept for r in got[a + len(good) :])
    assert sorted(r.doc_id for r in quality.keep_good(docs(spark, texts)).collect()) == [r.doc_id for r in got if r.kept]
    assert quality.score(empty(spark)).count() == 0 and quality.keep_good(docs(spark)).columns == docs(spark).columns


def test_quality_posterior_by_force():
    """The posterior over vote vectors is that of the same model run over the documents one by one."""
    rnd = np.random.default_rng(4)
    k = 3
    votes = np.concatenate([rnd.choice([-1, 0, 1], p=[0.02, 0.3, 0.68], size=(400, k)), rnd.choice([-1, 0, 1], p=[0.5, 0.3, 0.2], size=(80, k))])
    counts = Counter(quality.pattern_of(votes).tolist())
    got = quality.fit(dict(counts), k)[quality.pattern_of(votes)]
    prior, belief = np.array([0.2, 0.8]), np.array([[0.35, 0.3, 0.35], [0.01, 0.4, 0.59]])
    table, weight, post = [[list(belief[c]) for _ in range(k)] for c in (0, 1)], 0.2 * len(votes) + 1, None
    for _ in range(quality.ROUNDS):
        p = np.array([[prior[c] * np.prod([table[c][j][v + 1] for j, v in enumerate(row)]) for c in (0, 1)] for row in votes])
        new = p / p.sum(axis=1, keepdims=True)
        if post is not None and np.abs(new - post).max() < 1e-9:
            break
        post = new
        prior = (post.sum(axis=0) + np.array([0.2, 0.8]) * weight) / (len(votes) + weight)
        for c in (0, 1):
            for j in range(k):
                seen = np.array([post[votes[:, j] == v, c].sum() for v in (-1, 0, 1)])
                table[c][j] = list((seen + belief[c] * weight) / (seen.sum() + weight))
    assert np.abs(got - post[:, 1]).max() < 1e-6


# ---- op3 --------------------------------------------------------------------------------------------


def test_licences(spark):
    texts = [None, "", "plain text", "He lost his driver's license.\nReleased under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\n", "All rights reserved.", "this work is licensed under the gnu general public license, version 3", "The court on copyright and Apache helicopters.", "license " * 3000]
    got = {}
    for r in licences.scan(docs(spark, texts)).where("kind = 'line'").collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert got[3] == [(0, "unknown"), (1, "mit")] and got[4] == [(1, "cc-by-nc")] and got[5] == [(0, "proprietary")] and got[6] == [(0, "gpl")]
    assert got[7] == [(0, "unknown")] and got[8] == [(0, "unknown")] and not {0, 1, 2} & set(got)
    assert licences.scan(empty(spark)).count() == 0
    notices = {t: k for family, k in zip(licences.FAMILIES, range(99), strict=False) for t in licences.NOTICES[family]}
    assert all(re.search(licences.CUES, t) for t in notices), "a notice without a cue could never be scored"
    model = licences.model()
    assert np.mean([model.predict(t)[0] == k for t, k in notices.items()]) > 0.95


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.",
}


def test_wrapped_licences(spark):
    texts = [f"The first line of a file.\n\n{t}\n\nAnd some text that follows it\nover two lines." for t in WRAPPED.values()]
    got = {}
    for r in licences.scan(docs(spark, texts)).where("family <> 'unknown'").collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.family))
    for i, family in enumerate(WRAPPED):
        assert any(f == family for _, f in got[i]) and all(f == family for _, f in got[i])
    assert all(("wrapped", f) in got[i] for i, f in enumerate(WRAPPED) if f != "apache-2.0")


def test_licence_scores_by_force(spark):
    rnd = random.Random(9)
    pieces = [t for ts in licences.NOTICES.values() for t in ts] + licences.COUNTER + ["license", "plain words", "copyright of the road"]
    texts = ["\n".join(rnd.choice(pieces) + rnd.choice(["", " and more of it", "!"]) for _ in range(4)) for _ in range(40)]
    model = licences.model()
    rows = licences.scan(docs(spark, texts)).collect()
    assert len(rows) > 60
    for r in rows:
        p = licences._softmax(((model.vector(r.text) @ model.w + model.b) / model.temperature)[None])[0]
        assert abs(p.max() - r.probability) < 1e-9
        k = int(p.argmax())
        grams = set(licences.ngrams(licences.tokens(r.text)))
        share = 0.0 if k == len(licences.FAMILIES) else max(len(grams & set(g)) / len(g) for g in (licences.ngrams(licences.tokens(t)) for t in licences.NOTICES[licences.FAMILIES[k]]))
        sure = k < len(licences.FAMILIES) and p.max() >= licences.LEAST_PROBABILITY and share >= licences.LEAST_TEMPLATE
        assert abs(share - r.template_share) < 1e-12 and r.family == (licences.FAMILIES[k] if sure else licences.UNKNOWN)


# ---- op10 -------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("aeioustnrl") for _ in range(rnd.randint(3, 8)))
    rows, labels = [], []
    for i in range(1200):
        words, toxic = [word() for _ in range(rnd.randint(30, 80))], i % 8 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiotx", "scumq", "zzyx" + word()]))
        rows.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts = rows + [None, "", "x" * 30_000]
    labels += [(None, 1), (5, None), (7, 0)]
    frame, marks = docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score(frame, toxicity.fit(frame, marks)).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(1200) if got[i].held_out]
    assert np.mean([got[i].predicted for i in held if i % 8 == 0]) > 0.9 and np.mean([got[i].predicted for i in held if i % 8]) < 0.02
    none = toxicity.score(frame, toxicity.fit(frame, marks.limit(0)))
    assert none.where("predicted = 1").isEmpty() and toxicity.score(empty(spark), toxicity.fit(empty(spark), marks)).count() == 0


def test_toxicity_scores_by_force(spark):
    rnd = random.Random(13)
    words = ["idiot", "idiots", "Shut", "up", "shut", "up!", "the", "(scum)", "scummy", "trashy,", "trash...", "good", "day", "drop", "dead"]
    texts = [None, "", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(150)]]
    keys = toxicity.fixed_voters()
    weights = np.linspace(-1, 2, len(keys))
    model = toxicity.Model(keys, weights, -2.0)
    entries, phrases = set(toxicity.LEXICON), set(toxicity.PHRASES)
    of = lambda text: toxicity.features(pa.array([text]))[1]
    begin = lambda e: int(of(e + "x")[list(toxicity.BEGINNINGS).index(len(e.encode())) + 1])
    weight = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    for r in toxicity.score(docs(spark, texts), model).collect():
        plain = []
        for w in W.findall((texts[r.doc_id] or "").lower()):
            for _ in range(2):
                w = w[:-1] if len(w) > 1 and w[-1] in ".,;:!?\"'()" else w
            plain.append(w[1:] if len(w) > 1 and w[0] in ".,;:!?\"'()" else w)
        votes = {int(of(w)[0]) for w in plain if w in entries}
        votes |= {begin(e) for w in plain for e in entries if len(e.encode()) in toxicity.BEGINNINGS and w.startswith(e) and len(w) > len(e)}
        votes |= {int(of(f"{a} {b}")[-1]) for a, b in zip(plain, plain[1:], strict=False) if f"{a} {b}" in phrases}
        logit = -2.0 + sum(weight[v] for v in votes)
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-12


def test_label_model_learns_accuracies_and_correlations():
    rnd = np.random.default_rng(3)
    n = 3000
    truth = rnd.random(n) < 0.2
    label = np.where(truth, rnd.random(n) < 0.75, rnd.random(n) < 0.03)
    one = np.where(truth, rnd.random(n) < 0.6, rnd.random(n) < 0.03)
    votes = np.stack([one, one, one, one, np.where(truth, rnd.random(n) < 0.6, rnd.random(n) < 0.03), np.where(truth, rnd.random(n) < 0.6, rnd.random(n) < 0.03)], axis=1)
    owner, voter = np.nonzero(votes)
    post = toxicity.label_model(owner, voter, label.astype(np.int64), 6)
    assert ((post > 0.5) == truth).mean() > (label == truth).mean() + 0.01
    d = toxicity.discounts(votes.astype(np.float32), truth.astype(float), votes[truth].mean(axis=0))
    assert (d[:4] > 2.5).all() and (d[4:] < 0.5).all()  # four copies of a voter count about once
