"""Installed trees on a file system that driver and executors share: written beside their place and swapped in, with a lock and a journal."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import PRIVATE, directory_tree

STALE_SECONDS = 3600


@contextmanager
def locked(target: str, stale: float = STALE_SECONDS):
    """Holds target.lock; a lock older than `stale` seconds counts as left behind."""
    path = f"{target.rstrip('/')}.lock"
    if os.path.exists(path) and time.time() - os.path.getmtime(path) > stale:
        os.unlink(path)
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def restore_metadata(path: str, mode: int | None, mtime_ns: int | None) -> None:
    """Permissions and time of a file, as far as they are known and the file system lets them be set."""
    with suppress(OSError):
        if mode is not None:
            os.chmod(path, mode & 0o777)
    with suppress(OSError):
        if mtime_ns is not None:
            os.utime(path, ns=(mtime_ns, mtime_ns))


def _put(root: str, row) -> None:
    place = os.path.join(root, row["path"])
    os.makedirs(os.path.dirname(place), exist_ok=True)
    part = f"{place}.part-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        file.write(row["content"])
    restore_metadata(part, row.get("mode"), row.get("mtime_ns"))
    os.replace(part, place)


def put_files(tree: DataFrame, root: str) -> int:
    """tree(path, content, mode, mtime_ns) as files below root, written by the tasks that hold them: root is a folder that all of them share.

    A file is written whole under a name of its own task and renamed, so tasks that run twice leave one file.
    """

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                _put(root, row)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    known = [c if c in tree.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("mode", "int"), ("mtime_ns", "bigint"))]
    return tree.select("path", "content", *known).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_tree(tree: DataFrame, target: str, document: dict, keep: bool = False) -> int:
    """tree(path, content, mode, mtime_ns) below target: staged by the tasks, journalled by phase, swapped in by the driver.

    Executors have to share target's folder. With keep, files of the installed tree that tree doesn't have are linked
    into the new one, not copied: a repair writes no more than what was damaged.
    """
    target = target.rstrip("/")
    with locked(target):
        staging, journal = f"{target}.staging-{uuid.uuid4().hex}", f"{target}.journal"
        os.makedirs(os.path.join(staging, PRIVATE))
        _note(journal, phase="write", staging=staging)
        n = put_files(tree, os.path.abspath(staging))
        if keep:
            n += _link_rest(target, staging)
        with open(os.path.join(staging, PRIVATE, "installed.json"), "w") as file:
            json.dump(document, file, sort_keys=True)
        backup = f"{target}.backup-{uuid.uuid4().hex}"
        _note(journal, phase="swap", staging=staging, backup=backup)
        if os.path.exists(target):
            os.rename(target, backup)
        try:
            os.rename(staging, target)
        except OSError:
            if os.path.exists(backup):
                os.rename(backup, target)
            raise
        _note(journal, phase="clean", backup=backup)
        shutil.rmtree(backup, ignore_errors=True)
        os.unlink(journal)
    return n


def _link_rest(target: str, staging: str) -> int:
    n = 0
    for folder, names, files in os.walk(target):
        names[:] = [x for x in names if x != PRIVATE]
        for name in files:
            place = os.path.join(staging, os.path.relpath(os.path.join(folder, name), target))
            n += 1
            if not os.path.exists(place):
                os.makedirs(os.path.dirname(place), exist_ok=True)
                os.link(os.path.join(folder, name), place)
    return n


def _note(journal: str, **fields) -> None:
    with open(journal, "w") as file:
        json.dump(fields, file)


def installed_document(target: str) -> dict | None:
    try:
        with open(os.path.join(target, PRIVATE, "installed.json")) as file:
            return json.load(file)
    except (OSError, ValueError):
        return None


def installed_tree(spark: SparkSession, target: str) -> DataFrame:
    return directory_tree(spark, f"file:{os.path.abspath(target)}").select("path", "content", "size")


def journal_of(target: str) -> dict | None:
    """What the journal of an unfinished install says: its phase and its folders."""
    try:
        with open(f"{target.rstrip('/')}.journal") as file:
            return json.load(file)
    except FileNotFoundError:
        return None
    except (OSError, ValueError) as error:
        return {"unreadable": str(error)}


def leftovers(target: str, fix: bool = False, stale: float = STALE_SECONDS) -> list[tuple[str, str, bool]]:
    """(path, kind, stale) of staging folders, backups, locks and journals beside target; stale ones go if asked."""
    target = os.path.abspath(target)
    folder, name = os.path.split(target)
    out = []
    for entry in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        for kind in ("staging-", "backup-", "lock", "journal"):
            if entry.startswith(f"{name}.{kind}"):
                path = os.path.join(folder, entry)
                old = time.time() - os.path.getmtime(path) >= stale
                out.append((path, kind.rstrip("-"), old))
                if fix and old and not (kind == "backup-" and not os.path.exists(target)):  # that backup is all there is
                    shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)
    return out
