"""Corpus reports: per-file metrics, the scoreboard and its round-trip part, triage sections, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import diff, scoreboard

KEYS = ["workbook", "sheet", "r", "c"]
FAILURES = ("spawn_failed", "timeout", "wait_failed", "output_too_large", "oom_or_crash", "process_crash", "process_exit", "schema_violation")


class DuplicateCode(ValueError):
    """A format index names a code twice."""


def format_index(spark: SparkSession, path: str) -> DataFrame:
    """(code, count) of a JSON format index: an array, or an object with ``formats`` or ``entries``. A code that occurs twice
    is an error."""
    entry = "array<struct<code:string,count:long>>"
    raw = spark.read.option("wholetext", "true").text(path)
    held = F.from_json("value", f"struct<formats:{entry},entries:{entry}>")
    items = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", entry)), held["formats"], held["entries"])
    out = raw.select(F.explode(items).alias("x")).select("x.code", "x.count")
    twice = out.groupBy("code").count().filter("count > 1").orderBy("code").first()
    if twice:
        raise DuplicateCode(f"format code {twice['code']!r} occurs twice")
    return out


def file_metrics(ours: DataFrame, theirs: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each file of ``files`` (workbook, ext, private, ok, theirs_ok, ms, rss): counts of the cell comparison, zero
    where a side has no document."""
    counts = diff.compare(diff.paired(ours, theirs, KEYS), ["workbook"])
    joined = files.join(counts, "workbook", "left")
    return joined.na.fill(0, [c for c in counts.columns if c != "workbook"])


def scoreboard_row(metrics: DataFrame, by: list | None = None) -> DataFrame:
    """One row (or one for each group): files, files opened by either side, ratios, and nearest-rank times and memory."""
    pairs = {
        "value": ("value_matched", "cells"), "display": ("display_matched", "display_total"), "formula": ("formula_matched", "formula_total"),
        "cached": ("cached_matched", "formula_total"), "coverage": ("a_covered", "a_cells"), "their_coverage": ("b_covered", "b_cells"),
    }
    sums = [F.sum(c).alias(f"{n}_{k}") for n, mt in pairs.items() for k, c in zip(("matched", "total"), mt)]
    out = metrics.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("opened"), F.count_if("theirs_ok").alias("their_opened"), *sums,
        scoreboard.nearest_rank("ms", 50).alias("ms_p50"), scoreboard.nearest_rank("ms", 95).alias("ms_p95"), scoreboard.nearest_rank("rss", 50).alias("rss_p50"), F.max("rss").alias("rss_max"),
    )
    out = out.withColumns({f"{n}_percent": scoreboard.percent(F.col(f"{n}_matched"), F.col(f"{n}_total")) for n in pairs})
    return out.withColumn("opened_percent", scoreboard.percent(F.col("opened"), F.col("files")))


def per_extension(metrics: DataFrame) -> DataFrame:
    return scoreboard_row(metrics, [scoreboard.extension().alias("ext")]).orderBy("ext")


def round_trip_row(rows: DataFrame) -> DataFrame:
    """``rows`` (status, total, value_matched, display_matched, extra, merges_equal, reread_ok, soffice_ok; the last two null
    where not tried): files compared, clean ones, and rates of those tried."""
    done = F.col("status") == "compared"
    clean = done & (F.col("value_matched") == F.col("total")) & (F.col("extra") == 0) & F.col("merges_equal")
    out = rows.agg(
        F.count_if(done).alias("files"), F.count_if(clean).alias("clean"), F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("total", "value_matched", "display_matched", "extra")],
        F.count_if("reread_ok").alias("reread_ok"), F.count("reread_ok").alias("reread_tried"), F.count_if("soffice_ok").alias("soffice_ok"), F.count("soffice_ok").alias("soffice_tried"),
    )
    rates = {"clean": ("clean", "files"), "value": ("value_matched", "total"), "display": ("display_matched", "total"), "reread": ("reread_ok", "reread_tried"), "soffice": ("soffice_ok", "soffice_tried")}
    return out.withColumns({f"{n}_percent": scoreboard.percent(F.col(a), F.col(b)) for n, (a, b) in rates.items()})


def drop_sections(exports: DataFrame, top: int = 20) -> DataFrame:
    """(category, n, private_n, examples) of what exports dropped; ``exports``: (path, private, dropped)."""
    each = exports.select("path", "private", F.explode("dropped").alias("category"), F.lit(1).alias("n"))
    return scoreboard.triage(each, top)


def failure_sections(runs: DataFrame, top: int = 20) -> DataFrame:
    """The same of failures by code; ``runs``: (path, private, code or null)."""
    return scoreboard.triage(runs.filter("code IS NOT NULL").select("path", "private", F.col("code").alias("category"), F.lit(1).alias("n")), top)


def observed(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(workbook, ok, code, msg) of each of ``files``: what its document says; a file without a document is an internal error."""
    own = documents.select("workbook", "ok", "code", "msg", F.lit(True).alias("__seen"))
    missing = F.col("__seen").isNull()
    return files.select("workbook").join(own, "workbook", "left").select(
        "workbook", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(missing, F.lit("internal_error")).otherwise(F.col("code")).alias("code"),
        F.when(missing, F.lit("there is no document")).otherwise(F.col("msg")).alias("msg"),
    )


def runnable(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest entries that can be read: all public ones, and private ones whose ``path`` is ``present``."""
    here = present.select("path").distinct().withColumn("__here", F.lit(True))
    return entries.join(here, "path", "left").filter(~F.col("private") | F.col("__here")).drop("__here")


def file_defects(results: DataFrame, defects: str) -> DataFrame:
    """(file, defect) of public files, one row for each of the array ``defects``, and a row without a file for how many private
    files have any: their paths stay out. ``results``: path, private and the array."""
    held = results.filter(F.size(defects) > 0)
    public = held.filter("NOT private").select(F.col("path").alias("file"), F.explode(defects).alias("defect"))
    private = held.filter("private").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return public.unionByName(private.select(F.lit(None).cast("string").alias("file"), F.concat(F.col("n").cast("string"), F.lit(" private files")).alias("defect")))


def merge_defects(results: DataFrame) -> DataFrame:
    """Of round trips: merged ranges that were lost or came to be. ``results``: path, private, merge_defects."""
    return file_defects(results, "merge_defects")


def read_back_defects(results: DataFrame) -> DataFrame:
    """Exports that came back clean here but that another reader does not open. ``results``: path, private, status, total,
    value_matched, extra, merges_equal, reread_ok, reread_error."""
    clean = (F.col("status") == "compared") & (F.col("value_matched") == F.col("total")) & (F.col("extra") == 0) & F.col("merges_equal")
    wrong = F.when(clean & ~F.col("reread_ok"), F.array(F.coalesce("reread_error", F.lit("unknown"))))
    return file_defects(results.withColumn("__wrong", F.coalesce(wrong, F.array().cast("array<string>"))), "__wrong")


def bucket_sections(buckets: DataFrame, top: int = 20) -> DataFrame:
    """The same for mismatch buckets; ``buckets``: (path, private, bucket, n), values by pairs of types or displays by format."""
    return scoreboard.triage(buckets.select("path", "private", F.col("bucket").alias("category"), "n"), top)


def show_ratio(matched: int | None, total: int | None) -> str:
    return "—" if not total else f"{100 * (matched or 0) / total:.2f}% ({matched or 0}/{total})"


def show_bytes(n: float | None) -> str:
    if n is None:
        return "—"
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return "—"


def show_ms(n: float | None) -> str:
    return "—" if n is None else f"{n:.3f}".rstrip("0").rstrip(".") + " ms"


def scoreboard_markdown(row) -> str:
    """The scoreboard of one :func:`scoreboard_row`."""
    lines = [
        ("files opened", show_ratio(row.opened, row.files)), ("their files opened", show_ratio(row.their_opened, row.files)), ("cell values", show_ratio(row.value_matched, row.value_total)),
        ("displays", show_ratio(row.display_matched, row.display_total)), ("display coverage", show_ratio(row.coverage_matched, row.coverage_total)), ("formula texts", show_ratio(row.formula_matched, row.formula_total)),
        ("cached results", show_ratio(row.cached_matched, row.cached_total)), ("time p50 / p95", f"{show_ms(row.ms_p50)} / {show_ms(row.ms_p95)}"), ("memory p50 / max", f"{show_bytes(row.rss_p50)} / {show_bytes(row.rss_max)}"),
    ]
    return "| metric | value |\n|---|---|\n" + "".join(f"| {a} | {b} |\n" for a, b in lines)


def _table(head: tuple[str, ...], rows: list[tuple]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |\n"
    return line(head) + "|" + "---|" * len(head) + "\n" + "".join(line(r) for r in rows)


def extensions_markdown(metrics: DataFrame) -> str:
    """A row for each extension of :func:`per_extension` (there are few)."""
    rows = [(r.ext, r.files, show_ratio(r.opened, r.files), show_ratio(r.value_matched, r.value_total), show_ratio(r.display_matched, r.display_total), show_ratio(r.formula_matched, r.formula_total)) for r in per_extension(metrics).collect()]
    return _table(("extension", "files", "opened", "values", "displays", "formulas"), rows)


def formats_markdown(coverage: DataFrame, top: int = 20) -> str:
    """The first formats of :func:`scoreboard.format_coverage`."""
    rows = [(f"`{r.code}`", "—" if r.corpus_count is None else r.corpus_count, r.files, show_ratio(r.covered, r.cells)) for r in coverage.limit(top).collect()]
    return _table(("format", "in the corpus", "files", "covered"), rows)


def round_trip_markdown(row) -> str:
    """The round-trip part of one :func:`round_trip_row`."""
    rows = [
        ("files clean", show_ratio(row.clean, row.files)), ("values", show_ratio(row.value_matched, row.total)), ("displays", show_ratio(row.display_matched, row.total)),
        ("extra cells", row.extra), ("failed", row.failed), ("read back", show_ratio(row.reread_ok, row.reread_tried)), ("opened by an office suite", show_ratio(row.soffice_ok, row.soffice_tried)),
    ]
    return _table(("metric", "value"), rows)


def triage_markdown(title: str, section: DataFrame) -> str:
    """A section of (category, n, private_n, examples) or of (file, defect)."""
    rows = section.collect()  # a section lists at most its top categories
    if not rows:
        return f"## {title}\n\nNothing was found.\n"
    if "defect" in section.columns:
        body = _table(("file", "defect"), [("private" if r.file is None else f"`{r.file}`", r.defect) for r in sorted(rows, key=lambda r: (r.file is None, r.file or "", r.defect))])
    else:
        body = _table(("category", "cells", "of private files", "files"), [(f"`{r.category}`", r.n, r.private_n, ", ".join(f"`{p}`" for p in r.examples)) for r in rows])
    return f"## {title}\n\n{body}"
