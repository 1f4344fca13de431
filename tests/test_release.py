"""Invariants of chunkers and releases, round trips, and negatives."""

import random

import numpy as np
import pytest

from strataloom.operators import chunking, codec, install, release
from strataloom.sources import store


def sequential_gear(data, gear, low, avg, high):
    mask, cuts, h, start = (1 << (avg.bit_length() - 1)) - 1, [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(gear[b])) & ((1 << 64) - 1)
        n = i + 1 - start
        if n >= high or n >= low and h & mask == 0:
            cuts.append(i + 1)
            start, h = i + 1, 0
    return cuts + ([len(data)] if start < len(data) else [])


def sequential_normalised(data, gear, low, avg, high, stride):
    base = 1 << (avg.bit_length() - 1)
    strict, easy = 2 * base - 1, max(base // 2 - 1, 0)
    cuts, start, n = [], 0, len(data)
    while start < n:
        if n - start <= max(low, 1):
            cuts.append(n)
            break
        end, h = min(start + high, n), 0
        for pos in range(start + low, end, stride):
            h = ((h << 1) + int(gear[data[pos]])) & ((1 << 64) - 1)
            if h & (strict if pos < start + avg else easy) == 0:
                end = pos + 1
                break
        cuts.append(end)
        start = end
    return cuts


@pytest.mark.parametrize("seed", range(12))
def test_cuts_equal_the_sequential_definition(seed):
    rnd = random.Random(seed)
    size = rnd.choice([0, 1, 63, 64, 65, 500, 5000, 20_000])
    alphabet = rnd.choice([2, 20, 256])
    data = bytes(rnd.randrange(alphabet) for _ in range(size))
    array, gear = np.frombuffer(data, dtype=np.uint8), chunking.gear_table()
    low, avg, high = rnd.choice([(64, 256, 1024), (1, 2, 8), (16, 16, 16), (10, 100, 300)])
    assert chunking.gear_cuts(array, gear, low, avg, high) == sequential_gear(data, gear, low, avg, high)
    for stride in (1, 4, 16):
        assert chunking.normalised_cuts(array, gear, low, avg, high, stride) == sequential_normalised(data, gear, low, avg, high, stride)


def tree(spark, rows):
    return spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows], "path string, content binary, size bigint")


FILES = [("data/empty.txt", b""), ("data/hello.txt", b"hello line\n" * 300), ("data/unicode_è.txt", "éè".encode() * 50), ("a-b", b"x" * 700), ("a/b", b"x" * 700)]


@pytest.mark.parametrize("mode", ["gear", "cdc", "fastcdc"])
def test_chunks_add_up(spark, mode):
    rows = chunking.content_chunks(tree(spark, FILES), mode).groupBy("path").sum("raw_len").collect()
    assert {r[0]: r[1] for r in rows} == {p: len(c) for p, c in FILES if c}


def test_chunker_arguments(spark):
    with pytest.raises(ValueError):
        chunking.fixed_chunks(tree(spark, FILES), 0)
    with pytest.raises(ValueError):
        chunking.content_chunks(tree(spark, FILES), "rabin")
    with pytest.raises(ValueError):
        chunking.content_chunks(tree(spark, FILES), "cdc", low=10, avg=5)


def test_first_writer_follows_components(spark):
    rows = release.first_writers(chunking.fixed_chunks(tree(spark, FILES[3:]))).collect()
    assert {r.first_path for r in rows} == {"a/b"}  # though "a-b" < "a/b" as strings


def test_release_round_trip(spark, tmp_path):
    t = tree(spark, FILES)
    doc = store.write_release(t, str(tmp_path / "r1"), "r1", 1)
    held = store.load_release(spark, str(tmp_path / "nowhere"), (str(tmp_path / "r1"),))
    assert held.document == doc and doc["metrics"]["file_count"] == 5
    assert {(r.path, bytes(r.content)) for r in store.extract_files(held).collect()} == set(FILES)
    assert store.verify(held).isEmpty()
    last = held.chunks.orderBy("pack_offset").collect()
    assert [r.pack_offset for r in last] == [sum(x.pack_len for x in last[:k]) for k in range(len(last))]
    assert doc["metrics"]["stored_bytes"] == sum(x.pack_len for x in last) < sum(x.raw_len for x in last)
    with pytest.raises(FileExistsError):
        store.write_release(t, str(tmp_path / "r1"), "r1", 1)
    assert store.write_release(t, str(tmp_path / "r1"), "r1", 1, force=True)["root_hash"] == doc["root_hash"]
    with pytest.raises(OSError):
        store.load_release(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        store.write_release(tree(spark, [("../up", b"x")]), str(tmp_path / "r2"), "r2", 2)


def test_fetch_and_repair(spark, tmp_path):
    store.write_release(tree(spark, FILES), str(tmp_path / "r"), "r", 3, chunk_size=256)
    held = store.load_release(spark, str(tmp_path / "r"))
    damaged = tree(spark, [(p, c + b"!" if p == "a-b" else c) for p, c in FILES if p != "a/b"] + [("extra", b"e")])
    states = {r.path: r.status for r in install.audit(held.files, damaged).collect()}
    assert states["a-b"] == "size-mismatch" and states["a/b"] == "missing" and states["extra"] == "extra"
    fixed = store.repair(held, damaged)
    assert {(r.path, bytes(r.content)) for r in fixed.collect()} == {(p, c) for p, c in FILES if p in ("a-b", "a/b")}
    _, downloads = store.fetch(held, damaged, None)
    assert downloads.count() == 0 or downloads.count() < held.chunks.count()
    with pytest.raises(ValueError):
        store.fetch(held, None, None, installed_seq=4)
    store.fetch(held, None, None, installed_seq=4, allow_downgrade=True)


@pytest.mark.parametrize("data", [b"", b"short", b"abc" * 400, bytes(random.Random(1).randrange(256) for _ in range(3000))])
def test_codecs_round_trip(data):
    for name in ("auto", "raw", "zlib", "zstd"):
        chosen, payload = codec.compress(data, name)
        assert codec.decompress(chosen, payload, len(data)) == data
    with pytest.raises(ValueError):
        codec.compress(b"x" * 100, "lzma")


def test_streams(spark, tmp_path):
    from strataloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"x" * 1000)
    (tmp_path / "in" / "b.bin").write_bytes(b"x" * 512 + b"y" * 256)
    files = ingest.file_stream(spark, str(tmp_path / "in"))
    for _ in range(2):
        ingest.store_batches(files, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    q = ingest.new_chunks(files).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 3


def test_ranges(spark, tmp_path):
    from strataloom.sources import chunkrepo, ranges

    (tmp_path / "pack").write_bytes(bytes(range(200)))
    chunkrepo.register(spark)
    got = spark.read.format("chunkrepo").option("path", str(tmp_path / "pack")).option("ranges", "0:5,100:3").option("shares", "2").load().collect()
    assert {(r.start, bytes(r.payload)) for r in got} == {(0, bytes(range(5))), (100, bytes([100, 101, 102]))}
    with pytest.raises(OSError):
        ranges.read_local_range(str(tmp_path / "pack"), 199, 2)
    assert ranges.read_url_range("http://nowhere.invalid/", 0, 0) == b""
    with pytest.raises(OSError):
        ranges.read_mirrors(lambda m: ranges.read_local_range(m, 0, 1), [str(tmp_path / "no"), str(tmp_path / "none")])


def test_trust(spark):
    import datetime as dt

    from strataloom.functions import trust

    key, other = trust.keygen(spark), trust.keygen(spark)
    doc = {"release_seq": 5, "root_hash": "ab", "expires_at": "2030-01-01T00:00:00", "not_before": None}
    sig, root = trust.sign(spark, doc, key), trust.trusted_root([key, key], "2031-01-01", allowed_mirrors=("https://m.example.com/",), min_release_seq=2)
    now = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    errors = lambda d=doc, s=sig, at=now, src=(): trust.trust_errors(spark, d, s, root, at, src)
    assert errors() == [] and len(root["trusted_keys"]) == 1
    assert errors(s=trust.sign(spark, doc, other)) == ["unknown-key"]
    assert errors(d=doc | {"release_seq": 6}) == ["bad-signature"]
    assert errors(s=None) == ["unsigned"]
    for change in ({"expires_at": "2031-01-01"}, {"not_before": "x"}, {"public_key_sha256": "0"}, {"algorithm": "rsa"}, {"signature": "AA=="}):
        assert errors(s=sig | change) == ["bad-signature"]
    assert errors(at=dt.datetime(2032, 1, 1, tzinfo=dt.timezone.utc)) == ["root-expired", "release-expired"]
    assert errors(src=("https://m.example.com", "https://x.example.com", "/local")) == ["source-not-allowed: https://x.example.com"]
    assert trust.hmac_token(b"k", "p", 5) == trust.hmac_token(b"k", "p", 5) != trust.hmac_token(b"k", "q", 5)
    assert trust.hmac_token(b"k", "p//", 5) == trust.hmac_token(b"k", "p", 5) and trust.hmac_token(b"k", "/p", 5) != trust.hmac_token(b"k", "p", 5)


CUTTINGS = [chunking.Cutting("fixed", fixed_size=300), chunking.Cutting("cdc", min=64, avg=256, max=1024), chunking.Cutting("cdc-fast", min=64, avg=256, max=1024, stride=4), chunking.Cutting("gear-cdc", min=64, avg=256, max=1024)]


@pytest.mark.parametrize("cutting", CUTTINGS, ids=lambda c: c.mode)
def test_stored_chunks_by_force(spark, cutting):
    import hashlib

    rnd = random.Random(5)
    files = FILES + [("x.gz", bytes(rnd.randrange(4) for _ in range(2000))), ("z/noise", bytes(rnd.randrange(256) for _ in range(900))), ("z/text", b"some text " * 200)]
    want, at = {}, 0
    for path, body in sorted(files, key=lambda f: f[0].split("/")):
        data, gear = np.frombuffer(body, dtype=np.uint8), chunking.gear_table()
        if cutting.mode == "fixed":
            cuts = [*range(300, len(body), 300), *([len(body)] if body else [])]
        elif cutting.mode == "gear-cdc":
            cuts = sequential_gear(data, gear, 64, 256, 1024)
        else:
            cuts = sequential_normalised(data, gear, 64, 256, 1024, 4 if cutting.mode == "cdc-fast" else 1)
        for a, b in zip([0, *cuts], cuts, strict=False):
            raw = body[a:b]
            if (key := hashlib.sha256(raw).hexdigest()) not in want:
                kind, packed = codec.compress(raw, "auto", path.endswith(".gz"))
                want[key] = (len(raw), path, a, kind, len(packed), hashlib.sha256(packed).hexdigest(), at)
                at += len(packed)
    stored = release.stored_chunks(tree(spark, files), cutting)
    got = {r.chunk_id: (r.raw_len, r.first_path, r.first_offset, r.codec, r.pack_len, r.compressed_hash, r.pack_offset) for r in release.pack_offsets(stored.drop("payload"), "pack_len").collect()}
    assert got == want
    assert {r.chunk_id: hashlib.sha256(r.payload).hexdigest() for r in codec.expand_chunks(stored).collect()} == {k: k for k in want}
    with pytest.raises(Exception, match="stored hash differs"):
        codec.expand_chunks(stored.withColumn("compressed_hash", stored.chunk_id)).collect()


@pytest.mark.parametrize("shape", ["flat", "one-folder", "deep"])
def test_orders_over_any_tree(spark, shape):
    from pyspark.sql import functions as F

    from strataloom.operators import prefix

    name = {"flat": "f{0:05d}", "one-folder": "d/f{0:05d}", "deep": "a/b{1}/c{2}/f{0:05d}"}[shape]
    paths = [name.format(k, k % 7, k % 3) for k in random.Random(2).sample(range(5000), 3000)]
    rows = spark.createDataFrame([(p, k % 13) for k, p in enumerate(paths)], "path string, n bigint").repartition(6)
    want, total = {}, 0
    for rank, (p, n) in enumerate(sorted(((p, k % 13) for k, p in enumerate(paths)), key=lambda x: x[0].split("/")), 1):
        want[p] = (rank, total)
        total += n
    order = [F.split("path", "/")]
    assert {r.path: r.k for r in prefix.ordinals(rows, order, "k").collect()} == {p: w[0] for p, w in want.items()}
    assert {r.path: r.before for r in prefix.sums_before(rows, order, "n", "before").collect()} == {p: w[1] for p, w in want.items()}
    assert prefix.ranged(rows, order).select("_range").distinct().count() > 1  # no task sees all rows
    assert prefix.sums_before(rows.limit(0), order, "n", "before").count() == 0


def test_root_hash_in_levels(spark):
    import hashlib

    files = [(f"d{k % 5}/f{k}", bytes([k % 251]) * (k % 90)) for k in range(300)]
    t = tree(spark, files)
    chunks = chunking.fixed_chunks(t, 16)
    assert release.bucket_digits(0) == release.bucket_digits(4096 * release.BUCKET_LINES) == 3 and release.bucket_digits(4096 * release.BUCKET_LINES + 1) == 6

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def folded(lines, digits):
        level = {}
        for key, line in lines:
            level.setdefault(sha(key)[:digits], []).append(line)
        level = {k: sha("\n".join(sorted(v))) for k, v in level.items()}
        while digits:
            digits -= 3
            above = {}
            for k, v in level.items():
                above.setdefault(k[:digits], []).append(f"{k} {v}")
            level = {k: sha("\n".join(sorted(v))) for k, v in above.items()}
        return level[""]

    for most, digits in ((1 << 16, 3), (0.05, 6)):
        got = release.root_hash(t, chunks, most).first()
        assert got.files_hash == folded([(p, f"{p} {len(c)} {hashlib.sha256(c).hexdigest()}") for p, c in files], digits)
    assert release.root_hash(t.limit(0), chunks.limit(0)).first().root_hash


def test_archives(spark, tmp_path):
    import io
    import tarfile

    from strataloom.operators import archive

    old = tree(spark, FILES)
    files = [(p, c + b"!" if p == "a-b" else c) for p, c in FILES] + [("long/" + "n" * 150, b"y" * 5000)]
    new = tree(spark, files)

    def size(rows):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as file:
            for p, c in rows:
                info = tarfile.TarInfo(p)
                info.size = len(c)
                file.addfile(info, io.BytesIO(c))
        return len(out.getvalue())

    got = {r.kind: r for r in archive.baseline_sizes(old, new).collect()}
    changed = [f for f in files if f not in FILES]
    assert (got["full"].files, got["changed"].files) == (6, 2)
    assert (got["full"].tar_bytes, got["changed"].tar_bytes) == (size(files), size(changed))
    assert 0 < got["changed"].zst_bytes < got["full"].zst_bytes < got["full"].tar_bytes and got["full"].gz_bytes < got["full"].tar_bytes
    assert archive.compressed_sizes(new, 3).first().gz_bytes >= got["full"].gz_bytes - 200
    assert archive.tar_sizes(new.limit(0)).first().tar_bytes == 10_240


def test_plan_errors():
    from strataloom.operators import diff

    name = lambda seq: {"release_id": f"r{seq}", "release_seq": seq, "root_hash": f"h{seq}"}
    plan = {"schema": "strata.patch-plan", "old": name(1), "new": name(2)}
    assert diff.plan_errors(plan, name(2), name(1)) == []
    assert diff.plan_errors(plan, name(3), name(1)) == ["target-root", "target-id", "target-seq"]
    assert diff.plan_errors(plan, name(2), None) == ["nothing-installed"]
    assert diff.plan_errors(plan | {"schema": "x", "old": name(3)}, name(2), name(1)) == ["not-a-plan", "target-older-than-source", "installed-root", "installed-seq", "installed-id"]


def test_plan_rows_that_differ(spark):
    from strataloom.operators import diff

    columns = "chunk_id string, raw_len bigint, codec string, compressed_hash string, pack_id string, pack_offset bigint, pack_len bigint"
    rows = [("a", 5, "raw", "h", "p", 0, 5), ("b", 6, "zstd", "h", "p", 5, 4), ("c", 7, None, "h", "p", 9, 7)]
    stored = spark.createDataFrame(rows, columns)
    assert diff.patch_plan_violations(stored, stored).isEmpty()
    bad = [("a", 5, "zlib", "h", "p", 0, 5), ("b", 6, "zstd", "h", "p", 5, None), ("c", 7, None, "h", "p", 9, 7), ("c", 7, None, "h", "p", 9, 7), ("d", 1, "raw", "h", "p", 0, 1), (None, 1, "raw", "h", "p", 0, 1)]
    got = {r.chunk_id: r.violation for r in diff.patch_plan_violations(spark.createDataFrame(bad, columns), stored).collect()}
    assert got == {"a": "differs: codec", "b": "differs: pack_len", "c": "duplicate", "d": "unknown", None: "missing-id"}


@pytest.fixture
def server(tmp_path):
    """A folder over HTTP with ranges and tags, and ways to fail."""
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        fail, tag, slow = 0, '"one"', 0.0

        def do_HEAD(self):
            self.send_response(200)
            self.send_header("ETag", Handler.tag)
            self.end_headers()

        def do_GET(self):
            import time

            time.sleep(Handler.slow)
            if Handler.fail:
                Handler.fail -= 1
                self.send_error(503)
                return
            data = (tmp_path / self.path.lstrip("/")).read_bytes()
            if (asked := self.headers.get("Range")) and self.headers.get("If-Range", Handler.tag) == Handler.tag:
                a, b = map(int, asked.removeprefix("bytes=").split("-"))
                data = data[a : b + 1]
                self.send_response(206)
            else:
                self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_address[1]}", Handler
    held.shutdown()


def test_client(tmp_path, server):
    import hashlib

    from strataloom.sources import remote

    base, handler = server
    raw = b"chunk " * 100
    kind, packed = codec.compress(raw)
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "p").write_bytes(b"?" * 7 + packed)
    row = {"chunk_id": hashlib.sha256(raw).hexdigest(), "raw_len": len(raw), "codec": kind, "compressed_hash": hashlib.sha256(packed).hexdigest(), "pack_offset": 7, "pack_len": len(packed)}
    url, local, gone = f"{base}/packs/p", str(tmp_path / "packs" / "p"), "http://127.0.0.1:9/packs/p"
    stats = {}
    handler.fail = 2
    assert remote.read_url(f"{base}/packs/p", 3, 0.01, stats) == b"?" * 7 + packed and stats["full_get_retries"] == 2
    handler.fail = 5
    with pytest.raises(OSError, match="after 2 attempts"):
        remote.read_url(url, 2, 0.01, stats)
    handler.fail = 0
    client = remote.Client(retries=1, backoff=0.0, blacklist_after=2)
    assert client.read([url], row) == raw and client.tag(url) == '"one"' and client.stats["head_requests"] == 1
    assert client.read([gone, url, url], row) == raw and client.mirror(gone)["failures"] == 1
    assert client.read([gone, url], row) == raw and client.stats["mirror_blacklist_events"] == 1
    assert client.candidates([gone, url]) == [url, gone] and client.read([local], row) == raw
    with pytest.raises(OSError, match="all mirrors failed"):
        client.read([local, url], row | {"compressed_hash": "0"})
    handler.tag = '"two"'
    with pytest.raises(OSError, match="changed"):
        client.read([url], row)
    client.tags.clear()
    client.hedge_delay = 0.05
    assert client.read([url, f"{base.replace('127.0.0.1', 'localhost')}/packs/p"], row, "hedged") == raw and client.stats["hedged_wins"] == 1
    assert client.read([gone, gone.replace("9/", "8/"), url], row, "hedged") == raw  # both that race fail
    client.save_mirrors(str(tmp_path / "state.json"))
    again = remote.Client()
    assert again.load_mirrors(str(tmp_path / "state.json")) and again.mirror(gone)["failures"] == client.mirror(gone)["failures"]
    assert not again.load_mirrors(str(tmp_path / "none.json"))
    (tmp_path / "state.json").write_text("[1]")
    assert not again.load_mirrors(str(tmp_path / "state.json")) and again.stats["mirror_state_error"]


def test_planner_edges(spark):
    """Null seconds and bytes, zero costs, and classes at their limits."""
    from pyspark.sql import functions as F

    from strataloom.functions import text as T
    from strataloom.plans import policy as P

    plans = spark.createDataFrame([(1, "untimed", False, 100, None), (2, "timed", False, 104, 9.0), (3, "ext", True, 99, None), (4, "nothing", True, None, 1.0)], "ordinal int, plan string, external boolean, bytes bigint, seconds double")
    r = P.recommend(P.enrich(plans.withColumn("downloads", F.lit(1)), 1.0, 0.0), []).first()
    assert (r.smallest, r.public, r.own_smallest, r.own_fastest) == ("ext", "ext", "untimed", "timed")
    h = P.hybrid(plans).first()
    assert (h.smallest, h.own_best, h.default, h.speed) == ("ext", "untimed", "timed", "timed")
    assert P.hybrid(plans.where("plan <> 'timed'")).first().default == "untimed" and P.hybrid(plans.where("plan <> 'timed'")).first().speed is None
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda v, kind="double": F.lit(v).cast(kind)
    assert [one(P.verdict(lit(a), lit(b))) for a, b in ((0.0, 1.0), (1.0, 0.0), (None, 1.0), (0.79, 1.0), (0.8, 1.0), (1.2, 1.0), (1.21, 1.0))] == ["inconclusive"] * 3 + ["win", "near_tie", "near_tie", "loss"]
    assert [one(T.fmt_bytes(lit(n, "bigint"))) for n in (0, None, 1023, -2048, 5 << 40, 3000 << 40, 1 << 30)] == ["0 B", "0 B", "1023 B", "-2.00 KiB", "5.00 TiB", "3000.00 TiB", "1.00 GiB"]
    assert [one(T.fmt_cost(lit(x), "EUR")) for x in (None, 0.0, 5e-7, 0.5, 12.3456)] == ["0 EUR", "0 EUR", "0 EUR", "0.500000 EUR", "12.346 EUR"]
    assert [one(T.parse_size(F.lit(x))) for x in ("1.5", "1 000", " 1.5 K b ", "12 xb", "-2kb", "")] == [None, 1000, 1500, None, -2000, None]
    assert [one(T.precompressed_hint(F.lit(x))) for x in ("a.GZ", "a.tgz", "a.pdf", "d/.gz", "a.tar.zst", "a.avi", "a.heic", "gz")] == [True, False, True, False, True, False, True, False]
    assert [one(P.showcase_class(F.lit(ok), lit(w), lit(f))) for ok, w, f in ((False, 1.0, 2.0), (True, None, 2.0), (True, 1.0, 0.0), (True, 0.05, 1.0), (True, 0.85, 1.0))] == ["failed", "pass_metrics_unavailable", "near-parity-or-bad-fit", "high-reuse-win", "partial-win"]
    assert one(T.replace_strings(F.lit('{"a": "x\\"y"}'), 'x"', "z")) == '{"a": "zy"}'


def test_measured_plans_by_force(spark):
    from pyspark.sql import functions as F

    from strataloom.plans import drivers

    rnd = random.Random(8)
    noise = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    shared = noise(900)
    old = {"a/x": ("a", b"text " * 300), "a/y": ("a", shared), "b/x": ("b", shared), "b/z": ("b", b"")}
    new = {"a/x": ("a", b"text " * 300 + b"more"), "b/x": ("b", shared), "b/n": ("b", noise(500)), "c/e": ("c", b"")}
    frame = lambda rows: spark.createDataFrame([(p, bytearray(c), len(c), s) for p, (s, c) in rows.items()], "path string, content binary, size bigint, scenario string")
    cuttings = [chunking.Cutting("fixed", fixed_size=256), chunking.Cutting("cdc", min=64, avg=256, max=1024)]
    got = drivers.measure(frame(old), frame(new), cuttings, ["raw", "auto"], by=("scenario",))
    rows = {(r.scenario, r.plan): r for r in got.collect()}
    assert {p for _, p in rows} == {"raw:fixed", "auto:fixed", "raw:cdc", "auto:cdc"} and {s for s, _ in rows} == {"a", "b", "c"}
    for cutting in cuttings:
        for kind in ("raw", "auto"):
            for s in "abc":
                sets = []
                for side in (old, new):
                    part = {p: c for p, (at, c) in side.items() if at == s}
                    t = tree(spark, list(part.items())) if part else tree(spark, [("none", b"")]).limit(0)
                    sets.append({r.chunk_id: r.pack_len for r in release.stored_chunks(t, cutting, kind).collect()})
                r = rows[s, f"{kind}:{cutting.mode}"]
                assert r.download_pack_bytes == sum(n for k, n in sets[1].items() if k not in sets[0])
                assert (r.reused_chunks, r.new_unique_chunks) == (len(sets[0].keys() & sets[1].keys()), len(sets[1]))
                changed = sum(len(c) for p, (at, c) in new.items() if at == s and old.get(p, (s, None))[1] != c)
                assert r.changed_file_bytes == changed
    best = {r.scenario: r for r in drivers.choices(got, ("scenario",)).collect()}
    assert best["a"].update_bytes == min(rows["a", p].download_pack_bytes for _, p in rows if _ == "a") and best["c"].verdict == "inconclusive"
    whole = drivers.measure(frame(old), frame(new), cuttings[:1], ["raw"]).first()
    assert whole.files_changed == 3 and whole.files_removed == 2 and whole.download_pack_bytes >= 500
    assert drivers.external_plans(frame(old), frame(new)).count() == 4
    assert set(drivers.classed(got).select(F.collect_set("claim")).first()[0]) <= {"do_not_claim", "safe_positive_example", "qualified_positive_example", "negative_or_neutral_example", "negative_example"}
