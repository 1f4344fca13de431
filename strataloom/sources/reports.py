"""Reports: one CSV file, Markdown or HTML tables with every row; archives of reports; finding what is heavy."""

from __future__ import annotations

import hashlib
import html
import os
import zipfile

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, out: str) -> None:
    """One file with a header, columns in the frame's order."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(out)


def _text(v) -> str:
    return "" if v is None else str(v)


def markdown(rows: DataFrame, title: str = "") -> str:
    """A table with every row, which pass the driver partition by partition."""
    line = lambda xs: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    body = [line(map(_text, r)) for r in rows.toLocalIterator()]
    return "\n".join([*([f"# {title}", ""] if title else []), line(rows.columns), line(["-"] * len(rows.columns)), *body, ""])


def html_table(rows: DataFrame, title: str = "") -> str:
    row = lambda xs, tag: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs) + "</tr>"
    body = "".join(row(map(_text, r), "td") for r in rows.toLocalIterator())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{row(rows.columns, 'th')}{body}</table>"


# Suffixes of reports.
REPORTS = {".json", ".csv", ".md", ".txt", ".log", ".sha256"}


def _files(folder: str) -> list[tuple[str, str, int]]:
    """(relative path, path, size) in order."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    out = []
    for at, _, names in os.walk(folder):
        out += [(os.path.relpath(p, folder).replace(os.sep, "/"), p, os.path.getsize(p)) for p in (os.path.join(at, n) for n in names) if os.path.isfile(p)]
    return sorted(out, key=lambda x: x[0].split("/"))


def _zip(folder: str, out: str, max_mb: float, suffixes: set[str], manifest: bool) -> dict:
    most, every = int(max_mb * 1024 * 1024), [x for x in _files(folder) if os.path.abspath(x[1]) != os.path.abspath(out)]
    wanted = [x for x in every if os.path.splitext(x[0])[1].lower() in suffixes and not (manifest and x[0].split("/")[-1] in ("release.json", "plan.json"))]
    kept, large = [x for x in wanted if x[2] <= most], [{"path": x[0], "bytes": x[2]} for x in wanted if x[2] > most]
    answer = {"ok": bool(kept) or not manifest, "files_included": len(kept), "skipped_large": large, "skipped_others": len(every) - len(wanted), "bytes": 0}
    if os.path.exists(out):
        os.unlink(out)
    if not answer["ok"]:
        return answer
    lines = ["path,bytes,sha256"]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for rel, path, n in kept:
            file.write(path, rel)
            with open(path, "rb") as body:
                lines.append(f"{rel},{n},{hashlib.file_digest(body, 'sha256').hexdigest()}")
        if manifest:
            file.writestr("MANIFEST.csv", "\n".join(lines) + "\n")
    return answer | {"bytes": os.path.getsize(out)}


def light_zip(folder: str, out: str, max_mb: float = 50.0) -> dict:
    """The reports below a folder with their relative paths; larger ones are named and left out."""
    return _zip(folder, out, max_mb, REPORTS, False)


def review_zip(folder: str, out: str, max_mb: float = 10.0) -> dict:
    """Reports and pages without a release's own documents, and a manifest of their digests; not ok if there are none."""
    return _zip(folder, out, max_mb, REPORTS | {".html"}, True)


def cleanup(folder: str, min_mb: float = 100.0, apply: bool = False) -> dict:
    """Files from a size on that are no reports; they go if asked."""
    heavy = [x for x in _files(folder) if x[2] >= int(min_mb * 1024 * 1024) and os.path.splitext(x[0])[1].lower() not in REPORTS]
    for _, path, _ in heavy if apply else []:
        os.unlink(path)
    total = sum(x[2] for x in heavy)
    return {"ok": True, "matched_files": len(heavy), "matched_bytes": total, "removed_bytes": total if apply else 0, "files": [{"path": x[0], "bytes": x[2]} for x in heavy]}
