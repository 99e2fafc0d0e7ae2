"""Other tools as a source: a command for each file, its output captured within limits, its failures as codes."""

from __future__ import annotations

import shutil
import subprocess
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from gridloom import documents
from gridloom.session import ready

MAX_CAPTURE, MAX_SAID = 256 << 20, 4096


@dataclass
class Captured:
    """What a process said, and the code of its failure if it failed."""

    stdout: bytes
    stderr: bytes
    ms: float
    code: str | None = None
    msg: str | None = None


def crash_code(status: int) -> str:
    """Of an exit status that is not 0; a negative one is a signal."""
    return "oom_or_crash" if status == -9 else "process_crash" if status < 0 else "process_exit"


def find_on_path(name: str, path: str | None = None) -> str | None:
    """Where an executable is, on ``path`` or the environment's."""
    return shutil.which(name, path=path)


def run_captured(command: list[str], timeout_s: float = 60.0, max_bytes: int = MAX_CAPTURE, cwd: str | None = None) -> Captured:
    """Run a command to its end, but for no longer than ``timeout_s`` and no more than ``max_bytes`` of either output."""
    began = time.monotonic()
    passed = lambda: (time.monotonic() - began) * 1000
    try:
        process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=cwd)
    except OSError as problem:
        return Captured(b"", b"", passed(), "spawn_failed", str(problem))
    held, over = {"stdout": b"", "stderr": b""}, threading.Event()

    def drain(name: str) -> None:
        stream, parts, size = getattr(process, name), [], 0
        while chunk := stream.read1(1 << 16):
            size += len(chunk)
            if size > max_bytes:
                over.set()
                process.kill()
                break
            parts.append(chunk)
        held[name] = b"".join(parts)

    readers = [threading.Thread(target=drain, args=(n,), daemon=True) for n in held]
    for r in readers:
        r.start()
    late = False
    try:
        status = process.wait(timeout_s)
    except subprocess.TimeoutExpired:
        late = True
        process.kill()
        try:
            status = process.wait(10)
        except subprocess.TimeoutExpired:
            return Captured(b"", b"", passed(), "wait_failed", "the process does not end")
    for r in readers:
        r.join(10)
    for name in held:
        getattr(process, name).close()
    out = Captured(held["stdout"], held["stderr"], passed())
    if over.is_set():
        out.code, out.msg = "output_too_large", f"more than {max_bytes} bytes of output"
    elif late:
        out.code, out.msg = "timeout", f"not done in {timeout_s:g} seconds"
    elif status:
        said = out.stderr[:MAX_SAID].decode("utf-8", "replace").strip()
        out.code, out.msg = crash_code(status), f"exit status {status}" + (f": {said}" if said else "")
    return out


OBSERVED = "path string, ok boolean, code string, msg string, ms double, document string"


def observe(files: DataFrame, command: list[str], tool: str | None = None, timeout_s: float = 60.0, max_bytes: int = MAX_CAPTURE) -> DataFrame:
    """(path, ok, code, msg, ms, document) of a tool that prints a document: ``command`` and the path, for each of ``files``
    (path, sha256), on the executors. A document that breaks the schema is a failure too."""
    ready(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, sha in zip(batch["path"], batch["sha256"]):
                got = run_captured([*command, path], timeout_s, max_bytes)
                text = None
                if got.code is None:
                    document, wrong = documents.parse(got.stdout, sha, tool)
                    if document is None:
                        got.code, got.msg = "schema_violation", "; ".join(wrong[:5])
                    elif not document["ok"]:
                        got.code, got.msg = document["error"]["code"], document["error"]["msg"]
                    else:
                        text = got.stdout.decode("utf-8")
                rows.append((path, got.code is None, got.code, got.msg, got.ms, text))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OBSERVED.split(", ")])

    return files.select("path", "sha256").mapInPandas(run, OBSERVED)
