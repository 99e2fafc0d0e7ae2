"""A client of the NDJSON session: pipelined requests, responses in any order, and a script that looks a workbook over."""

from __future__ import annotations

import json
import queue
import subprocess
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from gridloom.operators.diff import probe_offsets
from gridloom.workbook import PROTOCOL

WINDOW = (64, 24)


class Failure(Exception):
    def __init__(self, code: str, msg: str):
        super().__init__(msg)
        self.code, self.msg = code, msg


@dataclass
class Metric:
    """One request: when it was sent, how long it took, and why it failed if it did."""

    id: int
    op: str
    began: float
    ms: float | None = None
    failure: Failure | None = None


class Client:
    """Requests go out at once; a response is kept until it is asked for, whatever its order."""

    def __init__(self, reader, writer, timeout_s: float = 30.0, process: subprocess.Popen | None = None):
        self.writer, self.timeout_s, self.process = writer, timeout_s, process
        self.metrics: dict[int, Metric] = {}
        self.pending: set[int] = set()
        self.answers: dict[int, dict] = {}
        self.dead: Failure | None = None
        self._next = 0
        self._lines: queue.Queue = queue.Queue()

        def read():
            for line in reader:
                self._lines.put(line)
            self._lines.put(None)

        threading.Thread(target=read, daemon=True).start()

    @classmethod
    def spawn(cls, command: list[str], timeout_s: float = 30.0) -> Client:
        try:
            process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        except OSError as problem:
            raise Failure("spawn_failed", str(problem)) from None
        return cls(process.stdout, process.stdin, timeout_s, process)

    def issue(self, op: str, **fields) -> int:
        if self.dead:
            raise self.dead
        self._next += 1
        number = self._next
        self.metrics[number] = Metric(number, op, time.monotonic())
        self.pending.add(number)
        try:
            self.writer.write(json.dumps({"id": number, "op": op} | fields) + "\n")
            self.writer.flush()
        except (OSError, ValueError) as problem:
            raise self.abort(Failure("process_died", str(problem))) from None
        return number

    def abort(self, failure: Failure, target: int | None = None) -> Failure:
        """Every request in flight fails: ``target`` with ``failure``, the others because of it. Nothing can be sent after."""
        for number in sorted(self.pending):
            own = target is None or number == target
            self.metrics[number].failure = failure if own else Failure("aborted", f"request {target} failed: {failure.code}")
        self.pending.clear()
        self.dead = failure
        if self.process and self.process.poll() is None:
            self.process.kill()
        return failure

    def receive(self, number: int) -> dict:
        """The response of a request; it may say that the request failed."""
        end = time.monotonic() + self.timeout_s
        while number not in self.answers:
            if self.dead:
                raise self.metrics[number].failure or self.dead
            try:
                line = self._lines.get(timeout=max(0.0, end - time.monotonic()))
            except queue.Empty:
                raise self.abort(Failure("timeout", f"no response in {self.timeout_s:g} seconds"), number) from None
            if line is None:
                raise self.abort(Failure("process_died", "the session ended before it had answered"))
            self._take(line)
        return self.answers.pop(number)

    def _take(self, line: str) -> None:
        try:
            response = json.loads(line)
            number = response["id"]
        except (ValueError, TypeError, KeyError):
            raise self.abort(Failure("protocol_error", "a response is no object with an id")) from None
        if not isinstance(number, int) or number not in self.pending:
            raise self.abort(Failure("protocol_error", "a response has an id that is unknown or was answered before"))
        self.pending.discard(number)
        metric = self.metrics[number]
        metric.ms = (time.monotonic() - metric.began) * 1000
        if response.get("ok") is False:
            metric.failure = Failure(str(response.get("code")), str(response.get("msg")))
        self.answers[number] = response

    def ask(self, op: str, check: Callable[[dict], object] | None = None, **fields) -> dict:
        """Send, wait, and hold the response to ``check``. A failed check marks the request."""
        return self.checked(self.issue(op, **fields), check)

    def checked(self, number: int, check: Callable[[dict], object] | None = None) -> dict:
        response = self.receive(number)
        if check:
            try:
                check(response)
            except Failure as problem:
                self.metrics[number].failure = problem
                raise
        return response

    def shutdown(self, wait_s: float = 5.0) -> Failure | None:
        """Close the requests' stream and let the process end; a failure if it does not, or not well."""
        try:
            self.writer.close()
        except (OSError, ValueError):
            pass
        if self.process is None:
            return None
        try:
            status = self.process.wait(wait_s)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()
            return Failure("timeout", "the session did not end")
        return None if status == 0 or self.dead else Failure("process_exit", f"exit status {status}")


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def success(response: dict, op: str) -> None:
    if response.get("ok") is False:
        raise Failure(str(response.get("code")), str(response.get("msg")))
    if response.get("ok") is not True:
        raise Failure("protocol_error", f"{op}: no ok")


def check_version(response: dict) -> None:
    success(response, "version")
    if response.get("proto") != PROTOCOL or not response.get("version"):
        raise Failure("protocol_error", "version: another protocol, or no version")


def extents(response: dict, op: str) -> list[tuple[int, int]]:
    """(rows, cols) of each sheet of a response."""
    sheets = response.get("sheets")
    if not isinstance(sheets, list) or not all(isinstance(s, dict) and _count(s.get("rows")) and _count(s.get("cols")) for s in sheets):
        raise Failure("protocol_error", f"{op}: no sheets with rows and cols")
    return [(s["rows"], s["cols"]) for s in sheets]


def check_open(response: dict) -> None:
    success(response, "open")
    if response.get("proto") != PROTOCOL or response.get("handle") in (None, ""):
        raise Failure("protocol_error", "open: another protocol, or no handle")
    extents(response, "open")


def check_meta(response: dict) -> None:
    success(response, "meta")
    extents(response, "meta")


def check_window(sheet: int, r0: int, c0: int, nr: int, nc: int) -> Callable[[dict], None]:
    """A window must name its place, be no larger than asked for, and hold as many rows and cells as it says."""

    def check(response: dict) -> None:
        success(response, "window")
        if (response.get("sheet"), response.get("r0"), response.get("c0")) != (sheet, r0, c0):
            raise Failure("protocol_error", "window: another place")
        hr, hc = response.get("nr"), response.get("nc")
        if not (_count(hr) and _count(hc) and hr <= nr and hc <= nc):
            raise Failure("protocol_error", "window: larger than asked for")
        rows = response.get("rows")
        if not isinstance(rows, list) or len(rows) != hr or any(not isinstance(x, list) or len(x) != hc for x in rows):
            raise Failure("protocol_error", "window: rows are not as many as said")
        if not isinstance(response.get("merges"), list):
            raise Failure("protocol_error", "window: no merges")

    return check


def check_stats(response: dict) -> None:
    success(response, "stats")
    if not _count(response.get("peakRssBytes")):
        raise Failure("protocol_error", "stats: no peakRssBytes")


@dataclass
class Looked:
    """What a script found out about one workbook."""

    opened: bool = False
    windows: int = 0
    probed: dict = field(default_factory=dict)
    exported: int | None = None
    peak_rss: int | None = None
    failure: Failure | None = None
    requests: list[Metric] = field(default_factory=list)


def look_over(client: Client, path: str, out: str | None = None, probes: list[tuple[int, int, int]] = ()) -> Looked:
    """version, open, meta with up to five windows of the first sheet at once, the cells of ``probes`` (sheet, r, c), a CSV
    export to ``out``, stats, close. The first failure is kept; what can still be asked is asked."""
    got = Looked()

    def note(problem: Failure) -> None:
        got.failure = got.failure or problem

    def attempt(work: Callable[[], object]):
        try:
            return work()
        except Failure as problem:
            note(problem)
            return None

    attempt(lambda: client.ask("version", check_version))
    opened = attempt(lambda: client.ask("open", check_open, path=path)) if not client.dead else None
    if opened:
        got.opened, handle = True, opened["handle"]
        meta = client.issue("meta", handle=handle)
        asked = []
        for rows, cols in extents(opened, "open")[:1]:
            for r0, c0 in probe_offsets(rows, cols, *WINDOW):
                asked.append((client.issue("window", handle=handle, sheet=0, r0=r0, c0=c0, nr=WINDOW[0], nc=WINDOW[1]), r0, c0))
        attempt(lambda: client.checked(meta, check_meta))
        for number, r0, c0 in asked:
            got.windows += attempt(lambda n=number, r=r0, c=c0: client.checked(n, check_window(0, r, c, *WINDOW))) is not None
        for sheet, r, c in probes:
            one = attempt(lambda s=sheet, r=r, c=c: client.ask("window", check_window(s, r, c, 1, 1), handle=handle, sheet=s, r0=r, c0=c, nr=1, nc=1))
            cell = one["rows"][0][0] if one and one["nr"] and one["nc"] else None
            got.probed[sheet, r, c] = cell and (cell["t"], cell["v"], cell["e"])
        if out is not None:
            said = attempt(lambda: client.ask("export", lambda r: success(r, "export"), handle=handle, format="csv", out=out, sheet=0))
            got.exported = said and said.get("bytes")
    stats = attempt(lambda: client.ask("stats", check_stats)) if not client.dead else None
    got.peak_rss = stats and stats["peakRssBytes"]
    if opened and not client.dead:
        attempt(lambda: client.ask("close", lambda r: success(r, "close"), handle=handle))
    if ended := client.shutdown():
        note(ended)
    got.requests = [client.metrics[k] for k in sorted(client.metrics)]
    return got
