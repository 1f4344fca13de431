"""`python -m strataloom.cli COMMAND`: releases from the shell. Answers are JSON; a failed check exits with 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from . import scratch


def _spark() -> SparkSession:
    return SparkSession.builder.appName("strataloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _abs(path: str) -> str:
    import os

    return path if "://" in path else f"file:{os.path.abspath(path)}"


def _cutting(a):
    from .operators.chunking import Cutting

    if a.profile:
        from .sources import local

        cutting, a.codec = local.profile_options(local.load_profile(a.profile))
        return cutting
    if a.chunk_size:
        return Cutting("fixed", fixed_size=a.chunk_size)
    return Cutting(a.chunker, a.fixed_size, a.chunk_min, a.chunk_avg, a.chunk_max, a.stride)


def _tree(spark, path: str):
    from .sources import trees

    tree = trees.directory_tree(spark, _abs(path)).select("path", "content", "size")
    return tree if "://" in path else tree.join(trees.local_metadata(spark, path), "path", "left")


def pack(spark, a):
    from .sources import store

    return store.write_release(_tree(spark, a.tree), _abs(a.out), a.id, a.seq, force=a.force, expires_at=a.expires_at, not_before=a.not_before, cutting=_cutting(a), codec_policy=a.codec)


def inspect(spark, a):
    from .sources import store

    return store.load_release(spark, _abs(a.release)).document


def verify(spark, a):
    from .sources import store

    bad = [r.asDict() for r in store.verify(store.load_release(spark, _abs(a.release))).limit(100).collect()]
    return {"ok": not bad, "bad": bad}


def release_check(spark, a):
    from .functions import checks
    from .sources import store

    held = store.load_release(spark, _abs(a.release))
    paths = held.files.select("path")
    issues = {
        "unsafe": [r.path for r in paths.where(checks.unsafe(F.col("path"))).limit(100).collect()],
        "unportable": [r.asDict() for r in paths.select("path", checks.portability(F.col("path")).alias("issues")).where("issues <> ''").limit(100).collect()],
        "collisions": [r.asDict() for r in checks.collisions(checks.casefold_keys(paths)).limit(100).collect()],
        "content": [r.asDict() for r in store.verify(held).limit(100).collect()],
    }
    told = held.files.agg(F.count_if(F.col("mode").isNull()).alias("without_mode"), F.count_if(F.col("mtime_ns").isNull()).alias("without_time")).first().asDict()
    document = held.document
    issues["document"] = [name for name, bad in (("schema", document.get("schema") != "strata.release"), ("version", document.get("version") != 2), ("root_hash", not document.get("root_hash")), ("metrics", document.get("metrics", {}).get("file_count") != held.files.count())) if bad]
    warnings = [told] if any(told.values()) else []
    warnings += [r.asDict() for r in checks.portability_warnings(paths).where("warnings <> ''").limit(100).collect()]
    return {"ok": not any(issues.values()), "portable_ok": not (issues["unsafe"] or issues["unportable"] or issues["collisions"]), "warnings": warnings} | issues


def diff(spark, a):
    from .operators import diff as d
    from .sources import store

    old, new = (store.load_release(spark, _abs(x)) for x in (a.old, a.new))
    return d.diff_summary(old.files, new.files, old.chunks, new.chunks).first().asDict()


def make_patch(spark, a):
    from .sources import store

    return store.write_plan(*(store.load_release(spark, _abs(x)) for x in (a.old, a.new)), _abs(a.out))


def baselines(spark, a):
    from .operators import archive
    from .sources import trees

    old, new = (trees.directory_tree(spark, _abs(x)).select("path", "content", "size") for x in (a.old, a.new))
    return {r.kind: r.asDict() for r in archive.baseline_sizes(old, new).collect()}


def compare_plans(spark, a):
    """Cut both trees by each chunker, store the chunks by each codec and hold what an update moves against whole archives."""
    from .operators.chunking import Cutting
    from .plans import drivers, policy
    from .sources import reports, trees

    old, new = (trees.directory_tree(spark, _abs(x)).select("path", "content", "size") for x in (a.old, a.new))
    sizes = (a.fixed_size, a.chunk_min, a.chunk_avg, a.chunk_max, a.stride)
    measured = scratch.durable(drivers.measure(old, new, [Cutting(m, *sizes) for m in a.chunkers.split(",")], a.codecs.split(","), timed=True))
    own = measured.select("ordinal", "plan", F.lit(False).alias("external"), F.col("download_pack_bytes").alias("bytes"), "seconds")
    external = drivers.external_plans(old, new).select((1000 + F.dense_rank().over(Window.orderBy("plan"))).alias("ordinal"), "plan", F.lit(True).alias("external"), "bytes", F.lit(None).cast("double").alias("seconds"))  # four rows
    plans = scratch.durable(own.unionByName(external).withColumn("downloads", F.lit(a.downloads)))
    costed = policy.enrich(plans, a.cost_per_gib, a.cost_per_hour)
    if a.report:
        with open(a.report, "w") as file:
            file.write(reports.markdown(costed.orderBy("ordinal"), "Plans"))
    adaptive = policy.adaptive(own.select("ordinal", F.substring_index("plan", ":", -1).alias("plan"), "bytes", "seconds")).first()
    return {"plans": [r.asDict() for r in plans.orderBy("ordinal").collect()], "recommended": policy.recommend(costed, []).first().asDict(), "hybrid": policy.hybrid(plans).first().asDict(), "adaptive": adaptive.asDict()}


def light_zip(spark, a):
    from .sources import reports

    return reports.light_zip(a.folder, a.out, a.max_mb)


def review_zip(spark, a):
    from .sources import reports

    return reports.review_zip(a.folder, a.out, a.max_mb)


def cleanup(spark, a):
    from .sources import reports

    return reports.cleanup(a.folder, a.min_mb, a.apply)


def extract(spark, a):
    from .sources import store

    held = store.load_release(spark, _abs(a.release))
    row = store.extract_files(held, spark.createDataFrame([(a.path,)], "path string")).first()
    if row is None:
        raise FileNotFoundError(a.path)
    with open(a.out, "wb") as file:
        file.write(row.content)
    return {"path": a.path, "size": row.size, "sha256": row.file_hash}


def fetch(spark, a):
    from .sources import installed, store

    held, now = store.load_release(spark, _abs(a.release), tuple(map(_abs, a.mirror))), installed.installed_document(a.install)
    own = installed.installed_tree(spark, a.install) if now else None
    allowed = store.load_plan(spark, _abs(a.plan), held, now)[1] if a.plan else None
    tree, missing = store.fetch(held, own, None, now and now["release_seq"], a.allow_downgrade, allowed)
    totals = missing.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("raw_len"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("pack_len"), F.lit(0)).alias("pack_bytes")).first()
    return {"files": installed.write_tree(tree, a.install, held.document), "downloaded_chunks": totals.chunks, "downloaded_bytes": totals.bytes, "downloaded_pack_bytes": totals.pack_bytes}


def audit_install(spark, a):
    from .operators import install
    from .sources import installed, store

    rows = install.audit(store.load_release(spark, _abs(a.release)).files, installed.installed_tree(spark, a.install))
    counts = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}
    return {"ok": not set(counts) - {"ok", "extra"}, "counts": counts}


def repair_install(spark, a):
    from .sources import installed, store

    held = store.load_release(spark, _abs(a.release))
    installed.write_tree(store.repair(held, installed.installed_tree(spark, a.install)), a.install, held.document, keep=True)
    return audit_install(spark, a)


def doctor(spark, a):
    from .sources import installed, local

    journal, found = installed.journal_of(a.install), installed.leftovers(a.install, a.fix)
    left = installed.leftovers(a.install)
    audit = audit_install(spark, a) if a.release else None
    cache = local.rebuild_index(spark, a.cache, a.fix) if a.cache else None
    return {"ok": not left and (audit is None or audit["ok"]), "journal": journal, "leftovers": found, "audit": audit, "cache": cache}


def cache_index(spark, a):
    from .sources import local

    return local.rebuild_index(spark, a.folder, a.prune)


def cache_gc(spark, a):
    from .sources import local

    return local.collect_garbage(spark, a.folder, local.size_of(a.limit), a.min_age)


def profile_show(spark, a):
    from .sources import local

    held = local.load_profile(a.profile)
    cutting, codec = local.profile_options(held)
    return {"ok": True, "name": held["name"], "description": held["description"], "cutting": vars(cutting), "codec": codec}


def digest(spark, a):
    from .sources import local

    return {"mode": a.mode, "sha256": local.digest(spark, a.path, a.mode)}


def root_init(spark, a):
    from .functions import trust
    from .sources import local

    keys = [local.read_key(k) for k in a.key]
    return trust.trusted_root(keys, a.expires_at, not a.unsigned, a.min_seq, tuple(a.allow))


def serve(spark, a):
    """Until it is interrupted."""
    import threading

    from .sources import server

    held = server.serve(a.folder, a.port, server.Faults(a.fail_every, 503, a.truncate_every, a.delay_ms))
    print(json.dumps({"port": held.server_address[1]}), flush=True)
    threading.Event().wait()


def keygen(spark, a):
    from .functions import trust

    return trust.keygen(spark)


def sign(spark, a):
    from .functions import trust
    from .sources import local, store

    return trust.sign(spark, store.load_release(spark, _abs(a.release)).document, local.read_key(a.key, private=True))


def query(spark, a):
    from . import registry

    rows = registry.queries()[a.name](spark, a.tables)
    return {"rows": [r.asDict() for r in rows.limit(a.limit).collect()]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(fn, *names, **options):
        p = sub.add_parser(fn.__name__.replace("_", "-"))
        for n in names:
            p.add_argument(n)
        for n, kw in options.items():
            p.add_argument("--" + n.replace("_", "-"), **kw)
        p.set_defaults(run=fn)

    flag = {"action": "store_true"}
    size = lambda n: {"type": int, "default": n}
    sizes = {"fixed_size": size(256 << 10), "chunk_min": size(64 << 10), "chunk_avg": size(256 << 10), "chunk_max": size(1 << 20), "stride": size(16)}
    add(pack, "tree", "out", id={"default": "release"}, seq=size(1), chunk_size=size(None), chunker={"default": "cdc"}, codec={"default": "auto"}, expires_at={"default": None}, not_before={"default": None}, profile={"default": None}, force=flag, **sizes)
    add(make_patch, "old", "new", "out")
    add(baselines, "old", "new")
    price = lambda x: {"type": float, "default": x}
    add(compare_plans, "old", "new", chunkers={"default": "fixed,cdc,fastcdc"}, codecs={"default": "auto"}, report={"default": None}, downloads=size(1000), cost_per_gib=price(0.05), cost_per_hour=price(1.0), **sizes)
    add(light_zip, "folder", "out", max_mb=price(50.0))
    add(review_zip, "folder", "out", max_mb=price(10.0))
    add(cleanup, "folder", min_mb=price(100.0), apply=flag)
    add(inspect, "release")
    add(verify, "release")
    add(release_check, "release")
    add(diff, "old", "new")
    add(extract, "release", "path", "out")
    add(fetch, "release", "install", mirror={"action": "append", "default": []}, plan={"default": None}, allow_downgrade=flag)
    add(audit_install, "release", "install")
    add(repair_install, "release", "install")
    add(doctor, "install", fix=flag, release={"default": None}, cache={"default": None})
    add(cache_index, "folder", prune=flag)
    add(cache_gc, "folder", "limit", min_age=size(0))
    add(profile_show, "profile")
    add(digest, "path", mode={"default": "tree-sha256"})
    add(root_init, key={"action": "append", "default": []}, allow={"action": "append", "default": []}, expires_at={"default": None}, min_seq=size(0), unsigned=flag)
    add(serve, "folder", port=size(0), fail_every=size(0), truncate_every=size(0), delay_ms=size(0))
    add(keygen)
    add(sign, "release", "key")
    add(query, "name", "tables", limit={"type": int, "default": 20})
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    answer = args.run(_spark(), args)
    print(json.dumps(answer, indent=2, sort_keys=True, default=str))
    return 2 if answer.get("ok") is False else 0


if __name__ == "__main__":
    sys.exit(main())
