"""The commands on real folders: pack, check, fetch, damage, repair."""

import json
import os

import pytest

from strataloom import cli
from strataloom.sources import installed, local, reports


def run(capsys, *argv):
    code = cli.main(list(argv))
    return code, json.loads(capsys.readouterr().out)


def test_life_of_a_release(spark, tmp_path, capsys):
    tree, r1, r2, target = (str(tmp_path / x) for x in ("tree", "r1", "r2", "target"))
    os.makedirs(f"{tree}/data")
    for name, body in (("data/a.txt", b"line\n" * 500), ("data/empty", b""), ("b.bin", bytes(range(256)) * 9)):
        with open(f"{tree}/{name}", "wb") as file:
            file.write(body)
    assert run(capsys, "pack", tree, r1, "--id", "one", "--chunk-size", "512")[1]["metrics"]["file_count"] == 3
    with open(f"{tree}/data/a.txt", "ab") as file:
        file.write(b"more")
    run(capsys, "pack", tree, r2, "--id", "two", "--seq", "2", "--chunk-size", "512")
    assert run(capsys, "inspect", r2)[1]["release_seq"] == 2 and run(capsys, "verify", r2)[0] == 0 and run(capsys, "release-check", r2)[0] == 0
    d = run(capsys, "diff", r1, r2)[1]
    assert (d["files_changed"], d["files_unchanged"], d["added_chunks"]) == (1, 2, 1)
    assert run(capsys, "fetch", r1, target)[1]["files"] == 3
    assert run(capsys, "fetch", r2, target)[1]["downloaded_chunks"] == 1
    with pytest.raises(ValueError):
        cli.main(["fetch", r1, target])
    os.unlink(f"{target}/b.bin")
    assert run(capsys, "audit-install", r2, target)[0] == 2 and run(capsys, "repair-install", r2, target)[0] == 0
    out = str(tmp_path / "x")
    assert run(capsys, "extract", r2, "b.bin", out)[1]["size"] == os.path.getsize(out) == 256 * 9
    assert run(capsys, "doctor", target)[0] == 0
    open(f"{target}.lock", "w").close()
    with pytest.raises(FileExistsError), installed.locked(target):
        pass
    assert run(capsys, "doctor", target)[0] == 2
    assert installed.leftovers(target, fix=True, stale=0) and not installed.leftovers(target)
    key = str(tmp_path / "key.json")
    with open(key, "w") as file:
        json.dump(run(capsys, "keygen")[1], file)
    assert run(capsys, "sign", r2, key)[1]["algorithm"] == "ed25519"


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, text string")
    assert reports.markdown(rows, "t").splitlines()[2:5] == ["| n | text |", "| - | - |", "| 1 | a\\|b |"]
    assert "<td>a|b</td>" in reports.html_table(rows, "t")
    reports.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_reports_are_whole(spark):
    assert reports.markdown(spark.range(2500)).count("\n") == 2502
    assert reports.html_table(spark.range(2500)).count("<tr>") == 2501


def test_archives_of_reports(tmp_path):
    import zipfile

    folder = tmp_path / "out"
    (folder / "a").mkdir(parents=True)
    for name, n in (("a/x.json", 10), ("big.csv", 3000), ("pack.bin", 5000), ("a/page.HTML", 5), ("release.json", 7)):
        (folder / name).write_bytes(b"x" * n)
    light = reports.light_zip(str(folder), str(tmp_path / "l.zip"), 2000 / 1024**2)
    assert light["files_included"] == 2 and light["skipped_large"] == [{"path": "big.csv", "bytes": 3000}]
    review = reports.review_zip(str(folder), str(tmp_path / "r.zip"), 2000 / 1024**2)
    assert review["ok"] and sorted(zipfile.ZipFile(tmp_path / "r.zip").namelist()) == ["MANIFEST.csv", "a/page.HTML", "a/x.json"]
    assert not reports.review_zip(str(folder), str(tmp_path / "r.zip"), 0)["ok"]
    assert reports.cleanup(str(folder), 1000 / 1024**2)["matched_files"] == 1 and (folder / "pack.bin").exists()
    assert reports.cleanup(str(folder), 1000 / 1024**2, apply=True)["removed_bytes"] == 5000 and not (folder / "pack.bin").exists()


def test_plans_and_metadata(spark, tmp_path, capsys):
    tree, r1, r2, target, plan = (str(tmp_path / x) for x in ("tree", "r1", "r2", "target", "plan"))
    os.makedirs(f"{tree}/bin")
    with open(f"{tree}/bin/run.sh", "wb") as file:
        file.write(b"echo\n" * 400)
    os.chmod(f"{tree}/bin/run.sh", 0o755)
    os.utime(f"{tree}/bin/run.sh", ns=(1_700_000_000_123_456_789,) * 2)
    small = ["--chunk-min", "64", "--chunk-avg", "256", "--chunk-max", "1024"]
    doc = run(capsys, "pack", tree, r1, "--id", "one", *small)[1]
    assert doc["chunker"]["mode"] == "cdc" and doc["metrics"]["stored_bytes"] < doc["metrics"]["logical_size"]
    run(capsys, "fetch", r1, target)
    state = os.stat(f"{target}/bin/run.sh")
    assert state.st_mode & 0o777 == 0o755 and state.st_mtime_ns == 1_700_000_000_123_456_789
    with open(f"{tree}/new.txt", "wb") as file:
        file.write(b"new\n" * 300)
    run(capsys, "pack", tree, r2, "--id", "two", "--seq", "2", *small)
    made = run(capsys, "make-patch", r1, r2, plan)[1]
    d = run(capsys, "diff", r1, r2)[1]
    assert made["download"]["pack_bytes"] == d["download_pack_bytes"] < d["download_raw_bytes"]
    assert run(capsys, "fetch", r2, target, "--plan", plan)[1]["downloaded_pack_bytes"] == d["download_pack_bytes"]
    with pytest.raises(ValueError, match="installed-root"):
        cli.main(["fetch", r2, target, "--plan", plan])
    capsys.readouterr()
    both = run(capsys, "compare-plans", tree, target, *small)[1]
    assert {p["plan"] for p in both["plans"]} >= {"auto:fixed", "auto:cdc", "external:full-tar.gz"} and both["recommended"]["own_smallest"]


def test_small_commands(spark, tmp_path, capsys):
    import hashlib

    cache = tmp_path / "cache"
    cache.mkdir()
    for k, body in enumerate((b"one", b"three", b"sevens!")):
        (cache / hashlib.sha256(body).hexdigest()).write_bytes(body)
        os.utime(cache / hashlib.sha256(body).hexdigest(), (1000 + k, 1000 + k))
    (cache / ("0" * 64)).write_bytes(b"wrong")
    (cache / "name").write_bytes(b"x")
    got = run(capsys, "cache-index", str(cache))[1]
    assert (got["chunk_count"], got["total_raw_bytes"]) == (3, 15) and sorted(b["reason"] for b in got["bad_entries"]) == ["not-a-chunk-name", "sha256-mismatch"]
    assert len(run(capsys, "cache-index", str(cache), "--prune")[1]["bad_entries"]) == 2 and not (cache / "name").exists()
    assert run(capsys, "cache-gc", str(cache), "12b")[1] == {"ok": True, "removed_bytes": 3, "chunk_count": 2, "total_raw_bytes": 12}
    local.touch(str(cache), {hashlib.sha256(b"three").hexdigest(): 5}, now=5000)
    assert run(capsys, "cache-gc", str(cache), "5")[1]["chunk_count"] == 1 and (cache / hashlib.sha256(b"three").hexdigest()).exists()
    assert local.read_index(str(tmp_path)) is None
    assert run(capsys, "digest", str(cache / hashlib.sha256(b"three").hexdigest()), "--mode", "file-sha256")[1]["sha256"] == hashlib.sha256(b"three").hexdigest()
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "d" / "f").write_bytes(b"abc")
    inner = hashlib.sha256(b"abc").hexdigest()
    assert run(capsys, "digest", str(tmp_path / "t"))[1]["sha256"] == hashlib.sha256(f"d/f\0" f"3\0{inner}\n".encode()).hexdigest()
    assert run(capsys, "digest", str(tmp_path / "t"), "--mode", "tree-sha256-nosize")[1]["sha256"] == hashlib.sha256(f"d/f\0{inner}\n".encode()).hexdigest()
    with pytest.raises(ValueError):
        local.digest(spark, str(tmp_path), "md5")
    assert local.csv_rows(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert local.csv_rows(spark, str(tmp_path / "a.csv")).first().asDict() == {"x": "1", "y": "2"}


def test_profiles_and_keys(spark, tmp_path, capsys):
    good = {"schema_version": 1, "name": "p", "description": "d", "chunker": "fastcdc", "codec": "zstd", "chunk_min": "64", "chunk_avg": "256", "chunk_max": "1 KiB", "fastcdc_stride": 4}
    path = str(tmp_path / "p.json")

    def write(**more):
        with open(path, "w") as file:
            json.dump({k: v for k, v in (good | more).items() if v is not None}, file)

    write()
    shown = run(capsys, "profile-show", path)[1]
    assert shown["cutting"] == {"mode": "fastcdc", "fixed_size": 256 << 10, "min": 64, "avg": 256, "max": 1024, "stride": 4}
    for bad in ({"extra": 1}, {"schema_version": 2}, {"name": " "}, {"chunker": "rabin"}, {"codec": "lzma"}, {"chunk_min": "2KiB"}, {"chunk_avg": None}, {"fastcdc_stride": 0}, {"metadata": "x"}, {"chunker": "fixed", "fixed_size": "0"}):
        write(**bad)
        with pytest.raises(ValueError):
            local.load_profile(path)
    write()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"text " * 500)
    doc = run(capsys, "pack", str(tmp_path / "t"), str(tmp_path / "r"), "--profile", path)[1]
    assert doc["chunker"]["stride"] == 4 and doc["codec_policy"] == "zstd"
    key = run(capsys, "keygen")[1]
    for name, held in (("k", key), ("public", {k: v for k, v in key.items() if k != "private_key"}), ("wrong", key | {"key_id": "0" * 16}), ("other", key | {"algorithm": "rsa"})):
        (tmp_path / name).write_text(json.dumps(held))
    assert local.read_key(str(tmp_path / "public"))["key_id"] == key["key_id"]
    for name, private in (("public", True), ("wrong", False), ("other", False)):
        with pytest.raises(ValueError):
            local.read_key(str(tmp_path / name), private)
    root = run(capsys, "root-init", "--key", str(tmp_path / "k"), "--key", str(tmp_path / "public"), "--allow", "https://m.example.com/")[1]
    assert len(root["trusted_keys"]) == 1 and root["policy"]["allowed_mirrors"] == ["https://m.example.com"] and "private_key" not in json.dumps(root)


def test_doctor_keeps_the_last_backup(tmp_path, spark, capsys):
    target = str(tmp_path / "target")
    os.makedirs(f"{target}.backup-1")
    installed.leftovers(target, fix=True, stale=0)
    assert os.path.isdir(f"{target}.backup-1")  # nothing else is left of the install
    os.makedirs(target)
    installed.leftovers(target, fix=True, stale=0)
    assert not os.path.isdir(f"{target}.backup-1")
    with open(f"{target}.journal", "w") as file:
        json.dump({"phase": "swap"}, file)
    answer = run(capsys, "doctor", target)
    assert answer[0] == 2 and answer[1]["journal"] == {"phase": "swap"}


def test_server(tmp_path):
    import urllib.error
    import urllib.request

    from strataloom.sources import ranges, server

    (tmp_path / "f").write_bytes(bytes(range(200)))
    held = server.serve(str(tmp_path), faults=server.Faults(fail_every=4, truncate_every=3))
    url = f"http://127.0.0.1:{held.server_address[1]}/f"

    def get(**headers):
        with urllib.request.urlopen(urllib.request.Request(url, headers={k.replace("_", "-"): v for k, v in headers.items()})) as answer:
            return answer.status, answer.read()

    assert get() == (200, bytes(range(200)))  # 1
    assert get(Range="bytes=5-9", If_Range=server.tag_of(str(tmp_path / "f"))) == (206, bytes(range(5, 10)))  # 2
    with pytest.raises(Exception):  # 3: cut to half
        get(Range="bytes=0-99")
    with pytest.raises(urllib.error.HTTPError, match="503"):  # 4
        get()
    assert get(Range="bytes=5-9", If_Range='"old"')[0] == 200  # 5
    assert ranges.read_url_range(url, 190, 10, retries=4, backoff=0.0) == bytes(range(190, 200))  # 6 is cut, 7 comes
    with pytest.raises(urllib.error.HTTPError, match="503"):
        get()
    with pytest.raises(urllib.error.HTTPError, match="416"):  # 9
        get(Range="bytes=500-600")
    held.shutdown()


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import pkgutil, strataloom, __spark_entry__ as e; [__import__(m.name) for m in pkgutil.walk_packages(strataloom.__path__, 'strataloom.') if '.llm' not in m.name]; print(len(e.queries()) >= 100, set(e.oracle_sql()) <= set(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr[-2000:]
