"""Queries of the session, its protocol and client, other tools as sources, reports and files, over small fixed inputs."""

from __future__ import annotations

import json
import os
import queue
import sys
import tempfile
import threading

from pyspark.sql import functions as F

from gridloom import client, documents, process, serve
from gridloom.operators import reports, scoreboard
from gridloom.plans import samples
from gridloom.plans.twins import expects
from gridloom.plans.workbook_queries import tables, text_files
from gridloom.session import ready
from gridloom.sinks import files
from gridloom.sources import fetch, foreign
from gridloom.workbook import Refusal, Session, opened

BOOKS = {"formulas.xlsx": samples.formula_book, "reader.xlsx": samples.reader_book}


def session(spark) -> Session:
    """A session that opens the sample workbooks by name."""

    def opener(spark, path, limits):
        if path not in BOOKS:
            raise Refusal("io", "there is no such file")
        return opened(path, tables(spark, {path: BOOKS[path]()}, limits), budget_ms=60_000)

    ready(spark)
    return Session(spark, opener)


def said(spark, *requests: dict) -> list[dict]:
    return [json.loads(x) for x in serve.serve(session(spark), [json.dumps(q | {"id": k + 1}) for k, q in enumerate(requests)])]


OPEN = {"op": "open", "path": "formulas.xlsx"}


@expects("session_version", "ok boolean, proto int, caps long", [(True, 1, 6)])
def session_version(spark):
    r = said(spark, {"op": "version"})[0]
    return [(r["ok"], r["proto"], len(r["caps"]))]


@expects("session_open", "handle int, name string, rows int, cols int, truncated boolean", [(1, "Main", 3, 3, False), (1, "Second", 5, 3, False)])
def session_open(spark):
    r = said(spark, OPEN)[0]
    return [(r["handle"], s["name"], s["rows"], s["cols"], s["truncated"]) for s in r["sheets"]]


@expects("session_meta", "name string, frozen string, height double, width double", [("Reader", "2,1", 14.4, 9.14)])
def session_meta(spark):
    r = said(spark, {"op": "open", "path": "reader.xlsx"}, {"op": "meta", "handle": 1})[1]
    return [(s["name"], f"{s['frozenRows']},{s['frozenCols']}", s["defaultRowHeight"], s["defaultColWidth"]) for s in r["sheets"]]


@expects("session_window", "r int, c int, t string, value string, d string, e boolean", [(0, 1, "n", "4.0", "4.00", True), (0, 2, "n", "5.0", None, True), (1, 1, "b", "True", "TRUE", False), (1, 2, "d", "2024-02-29", "02-29-24", False)])
def session_window(spark):
    """A clipped window, results of formulas in place."""
    r = said(spark, OPEN, {"op": "window", "handle": 1, "sheet": 0, "r0": 0, "c0": 1, "nr": 2, "nc": 50})[1]
    return [(r["r0"] + i, r["c0"] + j, x["t"], str(x["v"]), x["d"], x["e"]) for i, row in enumerate(r["rows"]) for j, x in enumerate(row) if x]


@expects("session_recalc", "r int, c int, v double, d string, e boolean, evaluated long, skipped long", [(0, 0, 4.0, "4.00", False, 2, 0), (0, 1, 8.0, "8.00", True, 2, 0), (0, 2, 9.0, None, True, 2, 0)])
def session_recalc(spark):
    r = said(spark, OPEN, {"op": "recalc", "handle": 1, "overrides": [{"sheet": 0, "r": 0, "c": 0, "v": 3}, {"sheet": 0, "r": 0, "c": 0, "v": 4}]})[1]
    return [(x["r"], x["c"], x["v"], x["d"], x["e"], r["evaluated"], r["skipped"]) for x in r["changed"]]


@expects("session_export_csv", "line string, applied int", [("4.00,8.00,9", 1), ('"a,""b""",TRUE,02-29-24', 1), ("7,,", 1)])
def session_export_csv(spark):
    """Edits of another sheet are no edits of this one."""
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "o.csv")
        r = said(spark, OPEN, {"op": "export", "handle": 1, "format": "csv", "out": out, "overrides": [{"sheet": 0, "r": 0, "c": 0, "v": 4}, {"sheet": 1, "r": 0, "c": 0, "v": 1}]})[1]
        with open(out, newline="", encoding="utf-8") as f:
            return [(line, r["applied"]) for line in f.read().split("\r\n")[:-1]]


@expects("session_export_xlsx", "sheet int, r int, c int, t string, vn double, vs string, f string", [(0, 0, 0, "n", 10.0, None, None), (0, 0, 1, "n", 20.0, None, "A1*2"), (0, 0, 2, "n", 21.0, None, "B1+1"), (0, 1, 0, "s", None, 'a,"b"', None), (0, 1, 1, "b", None, None, None), (0, 1, 2, "d", None, "2024-02-29", None), (0, 2, 0, "n", 7.0, None, "VLOOKUP(1,A1:B2,1)"), (0, 9, 0, "n", 30.0, None, "SUM(A1:B1)"), (1, 4, 2, "s", None, "far", None)])
def session_export_xlsx(spark):
    """Edits and an authored formula in the file that is written, results with them; read again."""
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "o.xlsx")
        said(spark, OPEN, {"op": "export", "handle": 1, "format": "xlsx", "out": out, "overrides": [{"sheet": 0, "r": 0, "c": 0, "v": 10}, {"sheet": 0, "r": 9, "c": 0, "f": "=SUM(A1:B1)"}]})
        with open(out, "rb") as f:
            return tables(spark, {"o.xlsx": f.read()}).cells


@expects("session_close", "op string, ok boolean, code string", [("close", True, None), ("meta", False, "not_found"), ("close", False, "not_found")])
def session_close(spark):
    got = said(spark, OPEN, {"op": "close", "handle": 1}, {"op": "meta", "handle": 1}, {"op": "close", "handle": 1})[1:]
    return [(op, r["ok"], r.get("code")) for op, r in zip(("close", "meta", "close"), got)]


@expects("session_stats", "handles int, rss boolean, store boolean", [(1, True, True)])
def session_stats(spark):
    r = said(spark, OPEN, {"op": "stats"})[1]
    return [(r["handles"], r["peakRssBytes"] > 1 << 20, r["storeBytes"] > 0)]


@expects("session_refusals", "id int, ok boolean, code string", [(1, False, "invalid"), (2, False, "invalid"), (3, False, "io"), (4, True, None), (5, False, "not_found"), (6, False, "invalid"), (7, False, "invalid"), (8, False, "too_large"), (9, False, "unsupported"), (None, False, "invalid")])
def session_refusals(spark):
    """Requests that are refused: by name, fields, file, sheet, size, edit, place and format; and a line that is no JSON."""
    requests = [{"op": "nope"}, {"op": "open"}, {"op": "open", "path": "none.xlsx"}, OPEN, {"op": "window", "handle": 1, "sheet": 9, "r0": 0, "c0": 0, "nr": 1, "nc": 1}, {"op": "window", "handle": 1, "sheet": 0, "r0": 0, "c0": 0, "nr": 9999, "nc": 9999}]
    requests += [{"op": "recalc", "handle": 1, "overrides": [{"sheet": 0, "r": 0, "c": 0}]}, {"op": "recalc", "handle": 1, "overrides": [{"sheet": 0, "r": 1 << 21, "c": 0, "v": 1}]}, {"op": "export", "handle": 1, "format": "pdf", "out": "x"}]
    lines = [json.dumps(q | {"id": k + 1}) for k, q in enumerate(requests)] + ["no json"]
    return [(r["id"], r["ok"], r.get("code")) for r in map(json.loads, serve.serve(session(spark), lines))]


class Wire:
    """A server in a thread behind a file-like pair, as a client of another process sees it."""

    def __init__(self, spark, **options):
        self.asked: queue.Queue = queue.Queue()
        self.told: queue.Queue = queue.Queue()
        self.server = serve.Server(session(spark), self.told.put, **options)

        def run():
            self.server.run(iter(self.asked.get, None))
            self.told.put(None)

        threading.Thread(target=run, daemon=True).start()

    def write(self, text: str) -> None:
        self.asked.put(text)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.asked.put(None)

    def lines(self):
        return iter(self.told.get, None)


@expects("session_cancel", "what string, code string", [("unknown id", "found: false"), ("request", "cancelled"), ("timeout", "timeout"), ("after", "ok")])
def session_cancel(spark):
    """A request at work is cancelled by its id, one with a deadline times out, and the session goes on."""
    wire = Wire(spark)
    slow = threading.Event()
    opener = wire.server.session.opener

    def waits(spark, path, limits):
        if path == "slow":
            slow.set()
            spark.range(1 << 34).filter("pmod(hash(id), 7) = 9").count()  # runs until its tag is cancelled
        return opener(spark, path, limits)

    wire.server.session.opener = waits
    c = client.Client(wire.lines(), wire, 60.0)
    none = c.ask("cancel", target=99)
    first = c.issue("open", path="slow")
    slow.wait(30)
    c.ask("cancel", target=first)
    cancelled = c.receive(first)
    late = c.ask("open", path="slow", timeoutMs=300)
    ok = c.ask("open", path="formulas.xlsx")
    c.shutdown()
    return [("unknown id", f"found: {str(none['found']).lower()}"), ("request", cancelled["code"]), ("timeout", late["code"]), ("after", "ok" if ok["ok"] else ok["code"])]


@expects("session_terminate", "cancelled boolean, ended boolean", [(True, True)])
def session_terminate(spark):
    """Told to stop, a server cancels what is at work and ends."""
    wire = Wire(spark)
    started = threading.Event()

    def waits(spark, path, limits):
        started.set()
        spark.range(1 << 34).filter("pmod(hash(id), 7) = 9").count()
        raise Refusal("internal", "not reached")

    wire.server.session.opener = waits
    c = client.Client(wire.lines(), wire, 60.0)
    number = c.issue("open", path="slow")
    started.wait(30)
    wire.server.stop.set()
    try:
        code = c.receive(number).get("code")
    except client.Failure as problem:
        code = problem.code
    return [(code == "cancelled", not wire.server.flight)]


@expects("client_script", "opened boolean, windows int, probe string, exported boolean, stats boolean, failure string, ops string", [(True, 1, "n 5.0 True", True, True, None, "version open meta window window export stats close")])
def client_script(spark):
    """version, open, meta, windows, a probe of a formula's cell, an export, stats, close: requests pipelined, answers in any order."""
    wire = Wire(spark)
    with tempfile.TemporaryDirectory() as folder:
        got = client.look_over(client.Client(wire.lines(), wire, 120.0), "formulas.xlsx", os.path.join(folder, "o.csv"), [(0, 0, 2)])
    t, v, e = got.probed[0, 0, 2]
    return [(got.opened, got.windows, f"{t} {v} {e}", (got.exported or 0) > 0, (got.peak_rss or 0) > 0, got.failure and got.failure.code, " ".join(m.op for m in got.requests))]


def _answers(*lines: str, asked: int = 1) -> str | None:
    """The code with which a client fails that gets ``lines`` for its requests."""

    class Nowhere:
        write = flush = close = staticmethod(lambda *_: None)

    c = client.Client(iter(lines), Nowhere(), 0.3)
    numbers = [c.issue("version") for _ in range(asked)]
    try:
        for n in numbers:
            c.receive(n)
    except client.Failure as problem:
        return problem.code
    return None


@expects("client_faults", "what string, code string", [("sound", None), ("out of order", None), ("unknown id", "protocol_error"), ("twice", "protocol_error"), ("no object", "protocol_error"), ("no json", "protocol_error"), ("death", "process_died"), ("no process", "spawn_failed")])
def client_faults(spark):
    one, two = '{"id": 1, "ok": true}', '{"id": 2, "ok": true}'
    out = [("sound", _answers(one)), ("out of order", _answers(two, one, asked=2)), ("unknown id", _answers('{"id": 7, "ok": true}')), ("twice", _answers(one, one, asked=2)), ("no object", _answers("[1]")), ("no json", _answers("hello")), ("death", _answers())]
    try:
        client.Client.spawn(["/nonexistent/tool"])
    except client.Failure as problem:
        out.append(("no process", problem.code))
    return out


def _checked(check, response: dict) -> str:
    try:
        check(response)
        return "ok"
    except client.Failure as problem:
        return problem.code


@expects("client_checks", "what string, outcome string", [("version", "ok"), ("other protocol", "protocol_error"), ("open", "ok"), ("open without handle", "protocol_error"), ("sheets without rows", "protocol_error"), ("refusal", "not_found"), ("window", "ok"), ("other place", "protocol_error"), ("too wide", "protocol_error"), ("ragged", "protocol_error"), ("stats", "ok"), ("stats without size", "protocol_error")])
def client_checks(spark):
    window = {"ok": True, "sheet": 0, "r0": 1, "c0": 2, "nr": 1, "nc": 2, "rows": [[None, None]], "merges": []}
    place = client.check_window(0, 1, 2, 3, 3)
    sheet = [{"rows": 1, "cols": 1}]
    return [
        ("version", _checked(client.check_version, {"ok": True, "proto": 1, "version": "1"})), ("other protocol", _checked(client.check_version, {"ok": True, "proto": 2, "version": "1"})),
        ("open", _checked(client.check_open, {"ok": True, "proto": 1, "handle": 1, "sheets": sheet})), ("open without handle", _checked(client.check_open, {"ok": True, "proto": 1, "sheets": sheet})),
        ("sheets without rows", _checked(client.check_meta, {"ok": True, "sheets": [{"cols": 1}]})), ("refusal", _checked(client.check_meta, {"ok": False, "code": "not_found", "msg": "x"})), ("window", _checked(place, window)),
        ("other place", _checked(place, window | {"r0": 0})), ("too wide", _checked(place, window | {"nc": 9})), ("ragged", _checked(place, window | {"rows": [[None]]})), ("stats", _checked(client.check_stats, {"ok": True, "peakRssBytes": 1})), ("stats without size", _checked(client.check_stats, {"ok": True})),
    ]


# Documents and other tools.


@expects("dump_document", "sheet string, rows int, cells int, merges string, faults int", [("Reader", 4, 15, "A3:B3 D3:F4", 0)])
def dump_document(spark):
    """The normalised document of a workbook, held to the strict check of its own fields and order."""
    book = opened("reader.xlsx", tables(spark, {"reader.xlsx": samples.reader_book()}))
    document = serve.dump(book, "reader.xlsx")
    return [(s["name"], s["rows"], len(s["cells"]), " ".join(s["merges"]), len(documents.faults(document))) for s in document["sheets"]]


def _document(**changes) -> dict:
    cell = {"r": 0, "c": 0, "t": "n", "v": 12.5, "d": None, "f": None, "fmt": None}
    sheet = {"name": "S", "index": 0, "rows": 2, "cols": 2, "truncated": False, "merges": ["A1:B1", "A2:B2"], "cells": [cell, cell | {"c": 1, "t": "s", "v": "x"}]}
    whole = {"schema": 1, "tool": "t", "toolVersion": "1", "file": "f", "sha256": "0" * 64, "ok": True, "error": None, "wallMs": 1.0, "peakRssBytes": None, "truncated": False, "sheets": [sheet | changes.pop("sheet", {})], "warnings": []}
    return whole | changes


@expects("document_faults", "what string, fault string", [("sound", None), ("missing", "document: warnings is missing"), ("unknown", "document: colour is unknown"), ("hash", "document: sha256 does not fit"), ("merges", "sheet 0: merges are not sorted ranges"), ("index", "sheet 0: index is 4"), ("extent", "sheet 0, cell (0, 1): outside the extent"), ("order", "sheet 0: cells are not in order"), ("value", "sheet 0, cell (0, 0): value does not fit its type"), ("error", "document: ok and error disagree")])
def document_faults(spark):
    base, cell = _document(), {"r": 0, "c": 0, "t": "n", "v": 1.0, "d": None, "f": None, "fmt": None}
    cases = {
        "sound": base, "missing": {k: v for k, v in base.items() if k != "warnings"}, "unknown": _document(colour=1), "hash": _document(sha256="0"), "merges": _document(sheet={"merges": ["A2:B2", "A1:B1"]}),
        "index": _document(sheet={"index": 4}), "extent": _document(sheet={"cols": 1}), "order": _document(sheet={"cells": [cell, cell]}), "value": _document(sheet={"cells": [cell | {"v": "1"}]}), "error": _document(ok=False),
    }
    return [(k, next(iter(documents.faults(d)), None)) for k, d in cases.items()]


@expects("process_codes", "what string, ok boolean, code string", [("sound", True, None), ("no tool", False, "spawn_failed"), ("exit", False, "process_exit"), ("killed", False, "oom_or_crash"), ("signal", False, "process_crash"), ("slow", False, "timeout"), ("loud", False, "output_too_large"), ("odd", False, "schema_violation"), ("refused", False, "bomb")])
def process_codes(spark):
    """A tool of its own process for each file, run by the executors: what it does wrong is a code."""
    python = lambda code: [sys.executable, "-c", code]
    good, bad = json.dumps(_document()), json.dumps(_document(ok=False, error={"code": "bomb", "msg": "x"}, sheets=[]))
    tools = {
        "sound": python(f"print({good!r})"), "no tool": ["/nonexistent/tool"], "exit": python("import sys; sys.exit(3)"), "killed": python("import os; os.kill(os.getpid(), 9)"), "signal": python("import os; os.kill(os.getpid(), 11)"),
        "slow": python("import time; time.sleep(60)"), "loud": python("print('x' * 10_000_000)"), "odd": python("print('{}')"), "refused": python(f"print({bad!r})"),
    }
    ready(spark)
    out = None
    for name, command in tools.items():
        one = spark.createDataFrame([("file", "0" * 64)], "path string, sha256 string")
        got = process.observe(one, command, timeout_s=2.0 if name == "slow" else 60.0, max_bytes=1 << 20).select(F.lit(name).alias("what"), "ok", "code")
        out = got if out is None else out.unionByName(got)
    return out


@expects("find_on_path", "name string, found boolean", [("sh", True), ("no-such-tool-anywhere", False)])
def find_on_path(spark):
    return [(n, process.find_on_path(n) is not None) for n in ("sh", "no-such-tool-anywhere")]


def _raw(spark):
    import datetime

    when, day = datetime.datetime(2024, 2, 29, 12, 30, 15, 250_000), datetime.datetime(2024, 2, 29)
    none = (None,) * 4
    rows = [
        ("w", 0, "A1", "n", 1.5, None, None, None, "1.50", None, " 0.00 "), ("w", 0, "B1", "s", None, "x", None, None, "x", "=UPPER(A1)", "General"), ("w", 0, "C1", "b", None, None, True, None, "TRUE", None, None),
        ("w", 0, "D1", "e", 7.0, None, None, None, None, None, None), ("w", 0, "E1", "e", 42.0, None, None, None, "#N/A", None, None), ("w", 0, "A2", "d", None, None, None, when, None, None, "yyyy"), ("w", 0, "B2", "d", None, None, None, day, None, None, None),
        ("w", 0, "C2", "d", None, "soon", None, None, None, None, None), ("w", 0, "D2", "str", None, "text", None, None, None, None, None), ("w", 0, "E2", "n", float("inf"), None, None, None, None, None, None), ("w", 0, "A3", "s", None, "", None, None, None, None, None),
        ("w", 0, "B3", "s", *none, None, "=", None), ("w", 0, "C3", "z", *none, None, "A1", None), ("w", 0, "!ref", "n", 1.0, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, foreign.RAW)


@expects(
    "foreign_cells", "r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string",
    [
        (0, 0, "n", 1.5, None, None, "1.50", None, "0.00"), (0, 1, "s", None, "x", None, "x", "UPPER(A1)", None), (0, 2, "b", None, None, True, "TRUE", None, None), (0, 3, "e", None, "#DIV/0!", None, None, None, None), (0, 4, "e", None, "#N/A", None, "#N/A", None, None),
        (1, 0, "d", None, "2024-02-29T12:30:15.250", None, None, None, "yyyy"), (1, 1, "d", None, "2024-02-29", None, None, None, None), (1, 2, "s", None, "soon", None, None, None, None), (1, 3, "s", None, "text", None, None, None, None), (1, 4, "n", None, None, None, None, None, None),
        (2, 2, "s", None, None, None, None, "A1", None),
    ],
)
def foreign_cells(spark):
    """Another reader's raw cells in the cell model."""
    return foreign.normalised(_raw(spark))


@expects("foreign_sheets", "sheet int, rows long, cols long, names string", [(0, 4, 3, "A1:B2 C4:D5"), (1, 0, 0, ""), (2, 0, 0, "")])
def foreign_sheets(spark):
    sheets = spark.createDataFrame([("w", 0, "B2:C4"), ("w", 1, None), ("w", 2, "junk")], "workbook string, sheet int, ref string")
    merges = spark.createDataFrame([("w", 0, 3, 2, 4, 3), ("w", 0, 0, 0, 1, 1), ("w", 0, 0, 0, 1, 1)], "workbook string, sheet int, r0 int, c0 int, r1 int, c1 int")
    named = foreign.sheet_extents(sheets).join(foreign.merge_names(merges), ["workbook", "sheet"], "left")
    return named.withColumn("names", F.coalesce(F.array_join("names", " "), F.lit("")))


@expects("foreign_failures", "file string, code string, faults int", [("a", "not_found", 0), ("b", "permission_denied", 0), ("c", "invalid_file", 0), ("d", "unreadable", 0), ("e", "timeout", 0)])
def foreign_failures(spark):
    kind = "file string, error string, msg string, wall_ms double, sha256 string, code string"
    rows = [("a", "ENOENT", "gone", 1.0, None, None), ("b", "EPERM", "", 1.0, None, None), ("c", "EISDIR", None, 1.0, None, None), ("d", "EWHAT", "x", 1.0, "0" * 64, None), ("e", None, "x", 1.0, None, "timeout")]
    made = foreign.failure_documents(spark.createDataFrame(rows, kind), "other", "1").collect()
    return [(r.file, json.loads(r.document)["error"]["code"], len(documents.faults(json.loads(r.document)))) for r in made]


@expects("observed_files", "workbook string, ok boolean, code string", [("a", True, None), ("b", False, "bomb"), ("c", False, "internal_error")])
def observed_files(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "workbook string")
    said = spark.createDataFrame([("a", True, None, None), ("b", False, "bomb", "x")], "workbook string, ok boolean, code string, msg string")
    return reports.observed(known, said)


@expects("runnable_entries", "id string", [("public",), ("private here",)])
def runnable_entries(spark):
    entries = spark.createDataFrame([("public", "p", False), ("private here", "q", True), ("private gone", "z", True)], "id string, path string, private boolean")
    return reports.runnable(entries, spark.createDataFrame([("q",), ("q",)], "path string"))


# Reports and files.


def _trips(spark):
    kind = "path string, private boolean, status string, total long, value_matched long, display_matched long, extra long, merges_equal boolean, reread_ok boolean, reread_error string, soffice_ok boolean, merge_defects array<string>"
    return spark.createDataFrame(
        [
            ("a.xlsx", False, "compared", 10, 10, 9, 0, True, True, None, True, []), ("b.xlsx", False, "compared", 10, 9, 9, 0, True, True, None, None, []), ("c.xls", False, "compared", 5, 5, 5, 0, True, False, "bad: b|c", None, []),
            ("d.xls", True, "compared", 5, 5, 5, 0, True, False, "secret", None, ["lost A1:B2"]), ("e.xlsx", False, "compared", 4, 4, 4, 1, False, None, None, None, ["lost A1:B2", "new C1:D1"]), ("f.xlsx", False, "failed", None, None, None, None, None, None, None, None, []),
        ],
        kind,
    )


@expects("round_trip_totals", "files long, clean long, failed long, total long, value_matched long, display_matched long, extra long, reread_ok long, reread_tried long, soffice_ok long, soffice_tried long, clean_percent double", [(5, 3, 1, 34, 33, 32, 1, 2, 4, 1, 1, 60.0)])
def round_trip_totals(spark):
    return reports.round_trip_row(_trips(spark))


@expects("merge_defects", "file string, defect string", [("e.xlsx", "lost A1:B2"), ("e.xlsx", "new C1:D1"), (None, "1 private files")])
def merge_defects(spark):
    return reports.merge_defects(_trips(spark))


@expects("read_back_defects", "file string, defect string", [("c.xls", "bad: b|c"), (None, "1 private files")])
def read_back_defects(spark):
    return reports.read_back_defects(_trips(spark))


@expects("round_trip_report", "line string", [("| metric | value |",), ("|---|---|",), ("| files clean | 60.00% (3/5) |",), ("| values | 97.06% (33/34) |",), ("| displays | 94.12% (32/34) |",), ("| extra cells | 1 |",), ("| failed | 1 |",), ("| read back | 50.00% (2/4) |",), ("| opened by an office suite | 100.00% (1/1) |",)])
def round_trip_report(spark):
    return [(x,) for x in reports.round_trip_markdown(reports.round_trip_row(_trips(spark)).first()).splitlines()]


@expects("triage_report", "line string", [("## Merges",), ("",), ("| file | defect |",), ("|---|---|",), ("| `e.xlsx` | lost A1:B2 |",), ("| `e.xlsx` | new C1:D1 |",), ("| private | 1 private files |",)])
def triage_report(spark):
    return [(x,) for x in reports.triage_markdown("Merges", reports.merge_defects(_trips(spark))).splitlines()]


@expects("drop_sections", "category string, n long, private_n long, examples string", [("styles", 3, 1, "a b"), ("merges", 1, 0, "a")])
def drop_sections(spark):
    exports = spark.createDataFrame([("a", False, ["styles", "merges"]), ("b", False, ["styles"]), ("c", True, ["styles"])], "path string, private boolean, dropped array<string>")
    return reports.drop_sections(exports).withColumn("examples", F.array_join("examples", " "))


@expects("failure_sections", "category string, n long, private_n long, examples string", [("bomb", 2, 1, "b"), ("bad_zip", 1, 0, "a")])
def failure_sections(spark):
    runs = spark.createDataFrame([("a", False, "bad_zip"), ("b", False, "bomb"), ("c", True, "bomb"), ("d", False, None)], "path string, private boolean, code string")
    return reports.failure_sections(runs).withColumn("examples", F.array_join("examples", " "))


@expects("bucket_sections", "category string, n long, private_n long, examples string", [("n/s", 7, 4, "a"), ("s/-", 1, 0, "b")])
def bucket_sections(spark):
    buckets = spark.createDataFrame([("a", False, "n/s", 3), ("p", True, "n/s", 4), ("b", False, "s/-", 1)], "path string, private boolean, bucket string, n long")
    return reports.bucket_sections(buckets).withColumn("examples", F.array_join("examples", " "))


def _metrics(spark):
    names = "workbook string, ext string, private boolean, ok boolean, theirs_ok boolean, ms double, rss long, cells long, value_matched long, display_total long, display_matched long, formula_total long, formula_matched long, cached_matched long, a_cells long, b_cells long, a_covered long, b_covered long"
    return spark.createDataFrame([("a", "XLSX", False, True, True, 2.0, 10, 10, 9, 5, 5, 2, 1, 2, 10, 10, 9, 10), ("b", None, False, False, True, 4.0, 30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ("c", "xlsx", True, True, True, 6.0, 20, 10, 10, 5, 4, 0, 0, 0, 10, 10, 10, 10)], names)


@expects("scoreboard_global", "files long, opened long, value_matched long, value_total long, ms_p50 double, ms_p95 double, rss_p50 double, rss_max long, opened_percent double", [(3, 2, 19, 20, 4.0, 6.0, 20.0, 30, 200 / 3)])
def scoreboard_global(spark):
    return reports.scoreboard_row(_metrics(spark))


@expects("extension_report", "line string", [("| extension | files | opened | values | displays | formulas |",), ("|---|---|---|---|---|---|",), ("| unknown | 1 | 0.00% (0/1) | — | — | — |",), ("| xlsx | 2 | 100.00% (2/2) | 95.00% (19/20) | 90.00% (9/10) | 50.00% (1/2) |",)])
def extension_report(spark):
    return [(x,) for x in reports.extensions_markdown(_metrics(spark)).splitlines()]


@expects("format_report", "line string", [("| format | in the corpus | files | covered |",), ("|---|---|---|---|",), ("| `0.00` | 50 | 2 | 75.00% (3/4) |",), ("| `@` | — | 1 | 100.00% (9/9) |",)])
def format_report(spark):
    per_file = spark.createDataFrame([("a", "0.00", 2, 1), ("b", "0.00", 2, 2), ("b", "@", 9, 9)], "file string, code string, cells long, covered long")
    ranking = spark.createDataFrame([("0.00", 50)], "code string, count long")
    return [(x,) for x in reports.formats_markdown(scoreboard.format_coverage(per_file, ranking)).splitlines()]


@expects("format_index", "code string, count long", [("0.00", 5), ("@", 2)])
def format_index(spark):
    return reports.format_index(spark, text_files(spark, "index", ['{"formats":[{"code":"0.00","count":5},{"code":"@","count":2}]}']))


@expects("json_sinks", "what string, text string", [("json", '{\n  "a": 1\n}\n'), ("lines", '{"id":0,"x":null}\n{"id":1,"x":"é"}\n'), ("unchanged", "False"), ("changed", "True")])
def json_sinks(spark):
    with tempfile.TemporaryDirectory() as folder:
        one, two = os.path.join(folder, "deep", "a.json"), os.path.join(folder, "b.jsonl")
        files.write_json(one, {"a": 1})
        files.write_lines(spark.range(2).select("id", F.when(F.col("id") == 1, "é").alias("x")).orderBy("id"), two)
        texts = []
        for path in (one, two):
            with open(path, encoding="utf-8") as f:
                texts.append(f.read())
        return [("json", texts[0]), ("lines", texts[1]), ("unchanged", str(files.write_if_changed(one, texts[0]))), ("changed", str(files.write_if_changed(one, "other")))]


@expects("manifest_sink", "line int, id string, wrote boolean, again boolean", [(0, "a.xlsx", True, False), (1, "b.xlsx", True, False)])
def manifest_sink(spark):
    """Lines in the order of ids, and nothing written twice."""
    entries = spark.createDataFrame([(n, f"corpus/files/{n}", "00", 3, "xlsx", "k", "https://x", "l", "2024-01-02T03:04:05Z", False) for n in ("b.xlsx", "a.xlsx")], "id string, path string, sha256 string, bytes long, ext string, collection string, source string, licence string, fetchedAt string, private boolean")
    with tempfile.TemporaryDirectory() as folder:
        paths = os.path.join(folder, "m.jsonl"), os.path.join(folder, "s.json")
        wrote = files.write_manifest(entries, scoreboard.manifest_summary(entries), *paths)
        again = files.write_manifest(entries, scoreboard.manifest_summary(entries), *paths)
        with open(paths[0], encoding="utf-8") as f:
            return [(k, json.loads(x)["id"], all(wrote), any(again)) for k, x in enumerate(f)]


# Connectors, as far as they can be shown without a network.


@expects("fetch_pace", "url string, waited double", [("https://a/1", 0.0), ("https://a/2", 0.5), ("https://b/1", 0.0), ("https://A/3", 0.5)])
def fetch_pace(spark):
    """Two requests a second to each host, by a clock that only sleeping moves."""
    now = [100.0]
    pace = fetch.Pace(2.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    return [(u, round(pace.wait(u), 6)) for u in ("https://a/1", "https://a/2", "https://b/1", "https://A/3")]


@expects("fetch_file", "what string, outcome string", [("fetched", "hello"), ("kept", "hello"), ("wrong hash", "FetchError"), ("missing", "FetchError")])
def fetch_file(spark):
    """A download by URL of a local file, kept if it is there, refused if its hash does not fit."""
    import hashlib
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        source, out = Path(folder, "source"), os.path.join(folder, "deep", "out")
        source.write_text("hello")

        def outcome(*args, **options):
            try:
                return Path(fetch.download(*args, pause_s=0.0, **options)).read_text()
            except fetch.FetchError:
                return "FetchError"

        sha = hashlib.sha256(b"hello").hexdigest()
        first = outcome(source.as_uri(), out, sha256=sha)
        return [("fetched", first), ("kept", outcome("file:///nonexistent", out, sha256=sha)), ("wrong hash", outcome(source.as_uri(), out + "2", sha256="0" * 64)), ("missing", outcome("file:///nonexistent", out + "3"))]


@expects("fetch_archive", "what string, outcome string", [("sound", "a.txt d/b.txt"), ("climbs", "FetchError"), ("link", "FetchError")])
def fetch_archive(spark):
    """An archive's files; one that leads outside, or holds a link, leaves nothing behind."""
    import io
    import tarfile

    def archive(path, *names, link=None):
        with tarfile.open(path, "w") as tar:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 1
                tar.addfile(info, io.BytesIO(b"x"))
            if link:
                info = tarfile.TarInfo("l")
                info.type, info.linkname = tarfile.SYMTYPE, link
                tar.addfile(info)
        return path

    with tempfile.TemporaryDirectory() as folder:
        where = lambda n: os.path.join(folder, n)
        out = []
        for name, path in (("sound", archive(where("1.tar"), "a.txt", "d/b.txt")), ("climbs", archive(where("2.tar"), "a.txt", "../up.txt")), ("link", archive(where("3.tar"), "a.txt", link="/etc/passwd"))):
            try:
                out.append((name, " ".join(fetch.extract_tar(path, where(f"{name}-out")))))
            except fetch.FetchError:
                out.append((name, "something is left" if os.path.exists(where(f"{name}-out")) else "FetchError"))
        return out


@expects("local_overlay", "id string, bytes long, ext string, private boolean", [("mine/a.xlsx", 3, "xlsx", True), ("mine/sub/b.XLS", 1, "xls", True)])
def local_overlay(spark):
    with tempfile.TemporaryDirectory() as folder:
        os.mkdir(os.path.join(folder, "sub"))
        for name, data in (("a.xlsx", b"abc"), (os.path.join("sub", "b.XLS"), b"x")):
            with open(os.path.join(folder, name), "wb") as f:
                f.write(data)
        return [(e["id"], e["bytes"], e["ext"], e["private"]) for e in fetch.local_overlay(folder, "mine")]
