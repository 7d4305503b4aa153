"""Contributions to an index: staged apart, applied whole or not at all; export documents and hand-off manifests.

All of it is metadata of driver size, a few files; what scales (digests of data files) runs as jobs.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_NAME = "EXPORT.json"


def _write(path: str, data: bytes) -> None:
    """Put a file under its name in one step."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(temporary, path)


def _inside(root: str, path: str) -> bool:
    return os.path.commonpath([os.path.realpath(root), os.path.realpath(path)]) == os.path.realpath(root)


def tree(root: str) -> dict[str, str]:
    """Digest of every file under a folder, by relative path."""
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            with open(path, "rb") as f:
                out[os.path.relpath(path, root)] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def stage(index: str, staging: str, files: dict[str, dict]) -> dict:
    """Write a contribution's documents beside an index: {path: document}; a file that the index has with other content is an error."""
    if _inside(index, staging):
        raise ValueError("a contribution is staged outside the index")
    final = os.path.join(staging, "contribution")
    if os.path.exists(final):
        raise ValueError(f"{final} is there already")
    os.makedirs(staging, exist_ok=True)
    temporary = tempfile.mkdtemp(dir=staging)
    try:
        for path, document in files.items():
            target = os.path.normpath(os.path.join(temporary, path))
            if not _inside(temporary, target):
                raise ValueError(f"{path} leaves the contribution")
            _write(target, (json.dumps(document, sort_keys=True, indent=1) + "\n").encode())
        digests = tree(temporary)
        for path, digest in digests.items():
            there = os.path.join(index, path)
            if os.path.exists(there):
                with open(there, "rb") as f:
                    if hashlib.file_digest(f, "sha256").hexdigest() != digest:
                        raise ValueError(f"the index holds another {path}")
        os.rename(temporary, final)
    except BaseException:
        shutil.rmtree(temporary, ignore_errors=True)
        raise
    return {"root": final, "files": digests}


def apply(index: str, contribution: dict, replace: bool = False) -> list[str]:
    """Copy a staged contribution into the index and verify it; anything that fails puts back what was there."""
    staged = tree(contribution["root"])
    if staged != contribution["files"]:
        raise ValueError("the staged files changed")
    before: dict[str, bytes | None] = {}
    try:
        for path in sorted(staged):
            target = os.path.join(index, path)
            old = None
            if os.path.exists(target):
                with open(target, "rb") as f:
                    old = f.read()
            with open(os.path.join(contribution["root"], path), "rb") as f:
                new = f.read()
            if old is not None and old != new and not replace:
                raise ValueError(f"the index holds another {path}")
            before[path] = old
            _write(target, new)
        applied = tree(index)
        if any(applied.get(path) != digest for path, digest in staged.items()):
            raise ValueError("the index doesn't hold what was applied")
    except BaseException:
        for path, old in before.items():
            target = os.path.join(index, path)
            if old is None:
                if os.path.exists(target):
                    os.remove(target)
            else:
                _write(target, old)
        raise
    return sorted(staged)


def export_document(name: str, files: DataFrame, sources: list[dict]) -> dict:
    """Document of an export: its files by path with digest and size, their sum, and where they come from."""
    rows = sorted((r.path, r.sha256, r.bytes) for r in files.select("path", "sha256", "bytes").collect())
    return {"schema": 1, "name": name, "bytes": sum(b for _, _, b in rows), "files": [{"path": p, "sha256": s, "bytes": b} for p, s, b in rows], "sources": sorted(sources, key=lambda s: s["name"])}


def write_export(folder: str, document: dict) -> str:
    if not document.get("files") or [f["path"] for f in document["files"]] != sorted({f["path"] for f in document["files"]}):
        raise ValueError("an export has files, sorted and unique")
    path = os.path.join(folder, EXPORT_NAME)
    _write(path, (json.dumps(document, sort_keys=True, indent=1) + "\n").encode())
    return path


def export_faults(document: dict, found: DataFrame) -> DataFrame:
    """(path, state): files of an export that are missing, unexpected or of other content; ``found`` has (path, sha256, bytes)."""
    spark = found.sparkSession
    declared = spark.createDataFrame([(f["path"], f["sha256"], f["bytes"]) for f in document["files"]], "path string, declared string, declared_bytes bigint")
    both = declared.join(found.select("path", "sha256", "bytes"), "path", "full_outer")
    state = F.when(F.col("declared").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") != F.col("declared")) | (F.col("bytes") != F.col("declared_bytes")), "differs")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")


def handoff_faults(manifest: dict, probe: DataFrame) -> DataFrame:
    """(path, state) where a hand-off manifest's inventory and the probe of its folder differ."""
    if manifest.get("schema") != 1 or not manifest.get("name") or not manifest.get("files"):
        raise ValueError("a hand-off manifest has a schema, a name and files")
    return export_faults(manifest, probe)
