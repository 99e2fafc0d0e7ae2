"""Bringing files in: downloads that resume and hold a pace, sparse checkouts of one commit, archives that cannot climb out.

Nothing here is called by a query of tables; a corpus is fetched once, on the driver, and read from its folder after.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from gridloom.process import run_captured


class FetchError(RuntimeError):
    pass


class Pace:
    """At most ``per_second`` requests a second to each host."""

    def __init__(self, per_second: float = 2.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / per_second, clock, sleep, {}

    def wait(self, url: str) -> float:
        """Sleep as long as the host's pace asks for; how long that was."""
        host, now = urllib.parse.urlsplit(url).netloc.lower(), self.clock()
        pause = max(0.0, self.last.get(host, -1e18) + self.gap - now)
        if pause:
            self.sleep(pause)
        self.last[host] = now + pause
        return pause


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def download(url: str, path: str, sha256: str | None = None, pace: Pace | None = None, tries: int = 4, agent: str = "gridloom", opener: Callable = urllib.request.urlopen, pause_s: float = 1.0) -> str:
    """The file at ``url`` under ``path``, renamed when it is whole. A part from an earlier try is asked to be continued; a
    file that is there and fits its hash is not fetched again. Missing files (404, 410) are not tried again."""
    if os.path.exists(path) and (sha256 is None or file_sha256(path) == sha256):
        return path
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part, problem = path + ".part", None
    for n in range(tries):
        if pace:
            pace.wait(url)
        have = os.path.getsize(part) if os.path.exists(part) else 0
        request = urllib.request.Request(url, headers={"User-Agent": agent} | ({"Range": f"bytes={have}-"} if have else {}))
        try:
            with opener(request, timeout=60) as source:
                resumed = have and getattr(source, "status", None) == 206
                with open(part, "ab" if resumed else "wb") as out:
                    shutil.copyfileobj(source, out, 1 << 20)
            if sha256 is None or file_sha256(part) == sha256:
                os.replace(part, path)
                return path
            problem = f"{url}: the hash does not fit"
            os.unlink(part)
        except urllib.error.HTTPError as wrong:
            problem = f"{url}: {wrong.code}"
            if wrong.code in (404, 410):
                break
            if wrong.code == 416 and have:
                os.unlink(part)
        except OSError as wrong:
            problem = f"{url}: {wrong}"
        if n + 1 < tries:
            time.sleep(pause_s * 2**n)
    raise FetchError(problem or url)


def extract_tar(archive: str, folder: str) -> list[str]:
    """The archive's files below ``folder``. Links, devices and names that lead outside are refused before anything is written."""
    root = os.path.realpath(folder)
    with tarfile.open(archive) as tar:
        members = tar.getmembers()
        for m in members:
            where = os.path.realpath(os.path.join(root, m.name))
            if os.path.isabs(m.name) or os.path.commonpath([root, where]) != root:
                raise FetchError(f"{m.name} leads outside")
            if not (m.isfile() or m.isdir()):
                raise FetchError(f"{m.name} is neither a file nor a folder")
        os.makedirs(root, exist_ok=True)
        tar.extractall(root, members, filter="data")
    return sorted(m.name for m in members if m.isfile())


def checkout(repository: str, commit: str, inside: str, folder: str, timeout_s: float = 600.0) -> str:
    """The path ``inside`` of a repository at ``commit``, without the history and without what lies beside it."""
    steps = (["init", "-q"], ["remote", "add", "origin", repository], ["config", "core.sparseCheckout", "true"], ["fetch", "-q", "--depth", "1", "origin", commit], ["checkout", "-q", "FETCH_HEAD"])
    os.makedirs(folder, exist_ok=True)
    for step in steps:
        if step[0] == "fetch":
            with open(os.path.join(folder, ".git", "info", "sparse-checkout"), "w", encoding="utf-8") as f:
                f.write(f"/{inside.strip('/')}/\n")
        got = run_captured(["git", "-C", folder, *step], timeout_s)
        if got.code:
            raise FetchError(f"git {step[0]}: {got.msg}")
    said = run_captured(["git", "-C", folder, "rev-parse", "HEAD"], timeout_s).stdout.decode().strip()
    if said != commit:
        raise FetchError(f"{commit} was asked for, {said} came")
    return os.path.join(folder, inside)


def local_overlay(folder: str, collection: str) -> list[dict]:
    """Entries of private files below a local folder: absolute paths, which stay out of what is published."""
    out = []
    for base, _, names in os.walk(folder):
        for name in sorted(names):
            path = os.path.realpath(os.path.join(base, name))
            ext = os.path.splitext(name)[1].lstrip(".").lower()
            out.append({"id": f"{collection}/{os.path.relpath(path, os.path.realpath(folder))}", "path": path, "sha256": file_sha256(path), "bytes": os.path.getsize(path), "ext": ext, "collection": collection, "source": f"file://{path}", "licence": "private", "private": True})
    return sorted(out, key=lambda e: e["id"])
