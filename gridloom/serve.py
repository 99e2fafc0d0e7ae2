"""NDJSON session: one request a line in, one response a line out; and the command line (dump, export, serve)."""

from __future__ import annotations

import argparse
import json
import queue
import signal
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from gridloom import __version__, schema
from gridloom.sources.rails import Limits
from gridloom.workbook import Refusal, Session, open_workbook

_REQUIRED = {
    "version": (), "open": ("path",), "meta": ("handle",), "window": ("handle", "sheet", "r0", "c0", "nr", "nc"), "recalc": ("handle",),
    "export": ("handle", "format", "out"), "close": ("handle",), "cancel": ("target",), "stats": (),
}


def _limits(q: dict) -> Limits:
    base = Limits()
    return Limits(max_cells=q.get("maxCells", base.max_cells), max_bytes=q.get("maxBytes", base.max_bytes), timeout_s=q.get("timeoutMs", base.timeout_s * 1000) / 1000)


def answer(session: Session, q: dict) -> dict:
    """The response of one request, without its id."""
    op = q.get("op")
    if op not in _REQUIRED:
        raise Refusal("invalid", "unknown operation")
    if missing := [k for k in _REQUIRED[op] if k not in q]:
        raise Refusal("invalid", f"{op} needs {', '.join(missing)}")
    if op == "version":
        return session.version()
    if op == "open":
        return session.open(q["path"], _limits(q))
    if op == "cancel":
        return session.cancel(str(q["target"]))
    if op == "stats":
        return session.stats()
    if op == "close":
        session.get(q["handle"])
        return session.close(q["handle"])
    book = session.get(q["handle"])
    if op == "meta":
        return book.meta()
    if op == "window":
        return book.window(q["sheet"], q["r0"], q["c0"], q["nr"], q["nc"])
    if op == "recalc":
        return book.recalc(q.get("overrides"))
    kind = str(q["format"]).lower()
    if kind == "csv":
        return book.export_csv(q["out"], q.get("sheet", 0), q.get("overrides"))
    if kind == "xlsx":
        s = q.get("sizeOverrides") or {}
        sizes = [(x["sheet"], "col", x["c"], x["width"]) for x in s.get("cols", [])] + [(x["sheet"], "row", x["r"], x["height"]) for x in s.get("rows", [])]
        return book.export_xlsx(q["out"], q.get("overrides"), sizes)
    raise Refusal("unsupported", "the format is csv or xlsx")


def _failed(number, code: str, msg: str) -> dict:
    return {"id": number, "ok": False, "code": code, "msg": msg}


def _parsed(line: str) -> dict:
    q = json.loads(line)
    if not isinstance(q, dict):
        raise ValueError("a request is an object")
    return q


def respond(session: Session, q: dict) -> dict:
    """The response of one request, failures included."""
    number = q.get("id")
    try:
        return {"id": number, "ok": True} | answer(session, q)
    except Refusal as problem:
        return _failed(number, problem.code, problem.msg)
    except (ValueError, KeyError, TypeError) as problem:
        return _failed(number, "invalid", str(problem))
    except Exception as problem:  # a fault of one request ends that request alone
        return _failed(number, "internal", f"{type(problem).__name__}: {problem}".splitlines()[0])


def serve(session: Session, lines: Iterable[str]) -> Iterator[str]:
    """One request after the other: each response before the next request is looked at."""
    for line in lines:
        if not line.strip():
            continue
        try:
            out = respond(session, _parsed(line))
        except ValueError as problem:
            out = _failed(None, "invalid", str(problem))
        yield json.dumps(out, ensure_ascii=False)


#: Requests that are answered at once, also while others are at work.
QUICK = ("version", "meta", "close", "cancel", "stats")


class Server:
    """Requests side by side: those that run Spark jobs are workers' work, each under a tag of its own.

    ``cancel`` names the id of a request; its jobs are stopped and it is answered as cancelled. A request with ``timeoutMs``
    that is not done in that time is answered as timed out and its jobs are stopped. Responses come as they are ready.
    """

    def __init__(self, session: Session, write: Callable[[str], None], workers: int = 4, poll_s: float = 0.005):
        self.session, self.write, self.poll_s = session, write, poll_s
        self.pool = ThreadPoolExecutor(workers, thread_name_prefix="gridloom")
        self.lines: queue.Queue = queue.Queue()
        self.flight: dict = {}  # id: [future, deadline or None, cancelled]
        self.dying: dict = {}  # tag: future of a request that was given up but may still start jobs
        self.stop = threading.Event()

    def _say(self, out: dict) -> None:
        self.write(json.dumps(out, ensure_ascii=False))

    def _tag(self, number) -> str:
        return f"gridloom-{id(self)}-{number}"

    def _start(self, q: dict) -> None:
        number = q.get("id")
        if number is None or number in self.flight:
            self._say(_failed(number, "invalid", "a request needs an id that is not in use"))
            return
        wait = q.get("timeoutMs")
        end = time.monotonic() + wait / 1000 if wait is not None else None
        work = lambda: self.session.tagged(self._tag(number), lambda: respond(self.session, q))
        self.flight[number] = [self.pool.submit(work), end, False]

    def _take(self, line: str) -> None:
        try:
            q = _parsed(line)
        except ValueError as problem:
            self._say(_failed(None, "invalid", str(problem)))
            return
        if q.get("op") == "cancel" and "target" in q:
            held = self.flight.get(q["target"])
            if held:
                held[2] = True
            self._say({"id": q.get("id"), "ok": True, "found": held is not None})
        elif q.get("op") in QUICK or q.get("op") not in _REQUIRED:
            self._say(respond(self.session, q))
        else:
            self._start(q)

    def _settle(self) -> None:
        now = time.monotonic()
        for number, (future, end, cancelled) in list(self.flight.items()):
            if future.done():
                problem = future.exception()
                out = _failed(number, "internal", f"{type(problem).__name__}: {problem}".splitlines()[0]) if problem else future.result()
                self._say(_failed(number, "cancelled", "the request was cancelled") if cancelled else out)
            elif cancelled or end is not None and now >= end:
                future.add_done_callback(self._forget)
                if not future.cancel():
                    self.dying[self._tag(number)] = future
                self._say(_failed(number, *(("cancelled", "the request was cancelled") if cancelled else ("timeout", "the request took too long"))))
            else:
                continue
            del self.flight[number]
        for tag, future in list(self.dying.items()):
            if future.done():
                del self.dying[tag]
            else:
                self.session.cancel(tag)  # again until it ends: it may have been between two jobs

    def _forget(self, future) -> None:
        """A workbook that was opened after its request had been given up is closed again."""
        if not future.cancelled() and not future.exception():
            handle = future.result().get("handle")
            if handle in self.session.handles:
                self.session.close(handle)

    def cancel_all(self) -> None:
        for held in self.flight.values():
            held[2] = True
        self.session.cancel_all()

    def run(self, lines: Iterable[str]) -> None:
        """Until the lines end and all requests are answered, or until ``stop`` is set."""

        def read():
            for line in lines:
                self.lines.put(line)
            self.lines.put(None)

        threading.Thread(target=read, daemon=True).start()
        ended = False
        while not self.stop.is_set() and not (ended and not self.flight):
            self.session.expire()
            self._settle()
            try:
                line = self.lines.get(timeout=self.poll_s)
            except queue.Empty:
                continue
            if line is None:
                ended = True
            elif line.strip():
                self._take(line)
        if self.stop.is_set():
            self.cancel_all()
        end = time.monotonic() + 10
        self._settle()
        while self.dying and time.monotonic() < end:
            time.sleep(self.poll_s)
            self._settle()
        self.pool.shutdown(wait=False, cancel_futures=True)


def dump(book, path: str, wall_ms: float = 0.0) -> dict:
    """One normalised document: sheets with their cells in row-major order, fields that are not there left out."""
    sheets = []
    for k, s in enumerate(book.sheets):
        extra = {"frozenRows": s["frozen_rows"], "frozenCols": s["frozen_cols"], "defaultRowHeight": s["default_row_height"], "defaultColWidth": s["default_col_width"]}
        sheets.append({"name": s["name"], "index": k, "rows": s["rows"], "cols": s["cols"], "truncated": s["truncated"], "merges": [], "cells": []} | {n: v for n, v in extra.items() if v})
    for x in book.cells.orderBy("sheet", "r", "c").toLocalIterator():
        value = x.vn if x.vn is not None else x.vb if x.vb is not None else x.vs
        sheets[x.sheet]["cells"].append({"r": x.r, "c": x.c, "t": x.t, "v": value, "d": x.d, "f": x.f, "fmt": x.fmt} | ({} if x.s is None else {"s": x.s}))
    for m in book.tables.merges.orderBy("sheet", "a1").collect():
        sheets[m.sheet]["merges"].append(m.a1)
    for x in book.tables.sizes.orderBy("sheet", "axis", "at").toLocalIterator():
        kind, names = ("colInfos", ("c", "width")) if x.axis == "col" else ("rowInfos", ("r", "height"))
        sheets[x.sheet].setdefault(kind, []).append(dict(zip(names, (x["at"], x["size"]))))
    fields = {"bold": "bold", "italic": "italic", "underline": "underline", "strike": "strike", "font_size": "fontSize", "font_name": "fontName", "font_color": "fontColor", "fill_color": "fillColor"}
    styles = [{new: r[old] for old, new in fields.items()} for r in book.tables.styles.orderBy("style_id").collect()]
    head = {"schema": schema.SCHEMA_VERSION, "tool": "gridloom", "toolVersion": __version__, "file": path, "sha256": book.info["sha256"], "ok": True, "error": None, "wallMs": wall_ms, "peakRssBytes": None}
    return head | {"truncated": book.info["truncated"], "sheets": sheets, "warnings": list(book.info["warnings"] or [])} | ({"styles": styles} if styles else {})


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("dump", "export"):
        p = sub.add_parser(name)
        p.add_argument("file")
        p.add_argument("--max-cells", type=int, default=200_000)
        p.add_argument("--max-bytes", type=int, default=Limits().max_bytes)
        if name == "export":
            p.add_argument("--format", choices=("csv", "xlsx"), required=True)
            p.add_argument("--out", required=True)
            p.add_argument("--sheet", type=int, default=0)
            p.add_argument("--overrides", help="a JSON array of edits")
    sub.add_parser("serve")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").config("spark.ui.enabled", "false").getOrCreate()
    if args.command == "serve":
        server = Server(Session(spark), lambda line: print(line, flush=True))
        signal.signal(signal.SIGTERM, lambda *_: server.stop.set())
        server.run(sys.stdin)
        return 0
    try:
        book = open_workbook(spark, args.file, Limits(max_cells=args.max_cells, max_bytes=args.max_bytes))
        if args.command == "dump":
            print(json.dumps(dump(book, args.file), ensure_ascii=False))
            return 0
        edits = None
        if args.overrides:
            with open(args.overrides, encoding="utf-8") as f:
                edits = json.load(f)
        print(json.dumps(book.export_csv(args.out, args.sheet, edits) if args.format == "csv" else book.export_xlsx(args.out, edits)))
    except Refusal as problem:
        print(json.dumps({"ok": False, "file": args.file, "error": {"code": problem.code, "msg": problem.msg}}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
