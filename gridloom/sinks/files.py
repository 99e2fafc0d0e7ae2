"""Small files on the driver: all or nothing, lines streamed, and written only where something changed."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.manifests import MANIFEST


def write_parts(path: str, parts: Iterable[bytes]) -> int:
    """A file of ``parts``, renamed when it is complete. Returns its bytes."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(fd, "wb") as out:
            for part in parts:
                out.write(part)
            size = out.tell()
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
    return size


def write_json(path: str, value) -> int:
    return write_parts(path, [json.dumps(value, ensure_ascii=False, indent=2).encode() + b"\n"])


def write_lines(df: DataFrame, path: str) -> int:
    """Rows as JSON lines in the frame's order, one partition in the driver at a time; null fields are written too."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    return write_parts(path, (r["line"].encode() + b"\n" for r in rows.toLocalIterator()))


def write_if_changed(path: str, text: str) -> bool:
    """Whether the file was written: it is left alone if it holds ``text`` already."""
    new = text.encode()
    try:
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size == len(new) and f.read() == new:
                return False
    except FileNotFoundError:
        pass
    write_parts(path, [new])
    return True


def write_manifest(entries: DataFrame, summary: DataFrame, manifest_path: str, summary_path: str) -> tuple[bool, bool]:
    """The manifest's lines by id, and its summary; which of the two had changed."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    ordered = entries.select(*names).orderBy("id")
    lines = ordered.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))
    text = "".join(r["line"] + "\n" for r in lines.toLocalIterator())  # a manifest lists at most a corpus of 4 GiB
    rows = [r.asDict() for r in summary.orderBy("kind", "name").collect()]
    return write_if_changed(manifest_path, text), write_if_changed(summary_path, json.dumps(rows, ensure_ascii=False, indent=2) + "\n")
