"""Safety rails: what a file must satisfy before it is read. Each refusal is a code and a message, never a failed job."""

from __future__ import annotations

import io
import re
import struct
import time
import zipfile
from dataclasses import dataclass
from xml.parsers import expat


@dataclass(frozen=True)
class Limits:
    max_cells: int = 5_000_000
    max_bytes: int = 100 << 20
    timeout_s: float = 30.0
    max_entries: int = 10_000
    max_part_bytes: int = 512 << 20
    max_total_bytes: int = 2 << 30
    max_ratio: int = 100
    ratio_floor: int = 256 << 20
    max_depth: int = 256
    max_token_bytes: int = 8 << 20
    max_tokens: int = 5_000_000
    max_extent: int = 8_000_000


class Refused(Exception):
    def __init__(self, code: str, msg: str):
        super().__init__(msg)
        self.code, self.msg = code, msg


class Clock:
    """A deadline that is looked at every few thousand steps."""

    def __init__(self, seconds: float):
        self.end, self.steps = time.monotonic() + seconds, 0

    def tick(self) -> None:
        self.steps += 1
        if self.steps % 4096 == 0 and time.monotonic() > self.end:
            raise Refused("timeout", "the file took too long to read")


def check_size(length: int, limits: Limits) -> None:
    if length > limits.max_bytes:
        raise Refused("too_large", f"file has {length} bytes; the limit is {limits.max_bytes}")


def open_zip(content: bytes, limits: Limits) -> zipfile.ZipFile:
    """An archive whose entries are within limits of number, size and compression."""
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise Refused("encrypted", "the package is encrypted or in the old binary format")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, EOFError, struct.error) as problem:
        raise Refused("bad_zip", str(problem)) from None
    entries = archive.infolist()
    if len(entries) > limits.max_entries:
        raise Refused("bomb", "too many entries")
    total = 0
    for e in entries:
        total += e.file_size
        if e.flag_bits & 1:
            raise Refused("encrypted", f"{e.filename} is encrypted")
        if e.file_size > limits.max_part_bytes or total > limits.max_total_bytes:
            raise Refused("bomb", f"{e.filename} is too large when unpacked")
        if e.file_size > limits.ratio_floor and e.file_size > limits.max_ratio * max(1, e.compress_size):
            raise Refused("bomb", f"{e.filename} is compressed too much")
    return archive


def read_part(archive: zipfile.ZipFile, name: str, limits: Limits) -> bytes:
    """A part's bytes; what it unpacks to is counted, not believed."""
    try:
        with archive.open(name) as f:
            data = f.read(limits.max_part_bytes + 1)
    except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, ValueError) as problem:
        raise Refused("bad_zip", f"{name}: {problem}") from None
    except Exception as problem:
        if type(problem).__name__ == "error":  # zlib.error
            raise Refused("bad_zip", f"{name}: {problem}") from None
        raise
    if len(data) > limits.max_part_bytes:
        raise Refused("bomb", f"{name} is too large when unpacked")
    return data


_LONG_REF = re.compile(r"[A-Za-z]{4,}[0-9]")
_REFS = {"c": "r", "dimension": "ref", "mergeCell": "ref", "autoFilter": "ref", "hyperlink": "ref"}


def walk_xml(data: bytes, limits: Limits, clock: Clock, start=None, end=None, text=None) -> None:
    """A pass over a part with handlers by local names; depth, tokens and references are within limits and there is no
    document type."""
    state = {"depth": 0, "tokens": 0}
    parser = expat.ParserCreate(namespace_separator="}")

    def count() -> None:
        state["tokens"] += 1
        clock.tick()
        if state["tokens"] > limits.max_tokens:
            raise Refused("bomb", "too many XML tokens")

    def on_start(name, attrs):
        count()
        state["depth"] += 1
        if state["depth"] > limits.max_depth:
            raise Refused("bomb", "XML is nested too deeply")
        local = name.rpartition("}")[2]
        plain = {k.rpartition("}")[2]: v for k, v in attrs.items()}
        if sum(map(len, plain.values())) > limits.max_token_bytes:
            raise Refused("bomb", "an XML token is too large")
        if local in _REFS and _LONG_REF.search(plain.get(_REFS[local], "")):
            raise Refused("bomb", "a reference lies outside the grid")
        if start:
            start(local, plain)

    def on_end(name):
        state["depth"] -= 1
        if end:
            end(name.rpartition("}")[2])

    def on_text(chunk):
        count()
        if text:
            text(chunk)

    def no_doctype(*_):
        raise Refused("bomb", "a document type is not allowed")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = on_start, on_end, on_text
    parser.StartDoctypeDeclHandler = no_doctype
    parser.buffer_text = True
    try:
        parser.Parse(data, True)
    except expat.ExpatError as problem:
        raise Refused("unsupported", f"malformed XML: {problem}") from None


def check_extent(rows: int, cols: int, limits: Limits) -> None:
    if rows * cols > limits.max_extent:
        raise Refused("bomb", f"an extent of {rows} by {cols} cells is too large")


class Compound:
    """A compound file's streams, every chain of sectors bounded by the number of sectors."""

    def __init__(self, content: bytes):
        if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(content) < 512:
            raise Refused("bad_zip", "not a compound file")
        self.data = content
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise Refused("bad_zip", "odd sector sizes")
        self.size, self.mini_size = 1 << shift, 64
        _, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<8I", content, 44)
        self.cutoff = cutoff
        self.sectors = max(0, (len(content) - self.size) // self.size + 1)
        difat = list(struct.unpack_from("<109I", content, 76))
        at, hops = first_difat, 0
        while at < 0xFFFFFFFA and n_difat:
            hops += 1
            if hops > self.sectors:
                raise Refused("bomb", "the sector table loops")
            block = struct.unpack_from(f"<{self.size // 4}I", self.sector(at))
            difat += block[:-1]
            at = block[-1]
        self.fat: list[int] = []
        for s in difat:
            if s < 0xFFFFFFFA and len(self.fat) < (self.sectors + self.size) * 2:
                self.fat += struct.unpack_from(f"<{self.size // 4}I", self.sector(s))
        self.mini = []
        if n_mini:
            raw = self.chain(first_mini)
            self.mini = list(struct.unpack_from(f"<{len(raw) // 4}I", raw))
        self.entries = {}
        raw, root = self.chain(first_dir), None
        for k in range(0, len(raw) - 127, 128):
            length, kind = struct.unpack_from("<HB", raw, k + 64)
            name = raw[k : k + max(0, min(64, length) - 2)].decode("utf-16-le", "replace")
            first, size = struct.unpack_from("<II", raw, k + 116)
            if kind == 5:
                root = (first, size)
            elif kind == 2:
                self.entries[name.lower()] = (first, size)
        self.pool = self.chain(root[0]) if root and root[0] < 0xFFFFFFFA else b""

    def sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        if at >= len(self.data):
            raise Refused("bad_zip", "a sector lies outside the file")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, first: int) -> bytes:
        out, at, hops = [], first, 0
        while at < 0xFFFFFFFA:
            hops += 1
            if hops > self.sectors + 1:
                raise Refused("bomb", "a chain of sectors loops")
            out.append(self.sector(at))
            if at >= len(self.fat):
                raise Refused("bad_zip", "a sector is not in the table")
            at = self.fat[at]
        return b"".join(out)

    def stream(self, *names: str) -> bytes:
        for name in names:
            if name.lower() in self.entries:
                first, size = self.entries[name.lower()]
                if size >= self.cutoff:
                    return self.chain(first)[:size]
                out, at, hops = [], first, 0
                while at < 0xFFFFFFFA:
                    hops += 1
                    if hops > len(self.mini) + 1 or at >= len(self.mini):
                        raise Refused("bomb", "a chain of small sectors loops")
                    out.append(self.pool[at * 64 : at * 64 + 64])
                    at = self.mini[at]
                return b"".join(out)[:size]
        raise Refused("bad_zip", "the workbook stream is missing")
