"""Corpus analytics: ratios, nearest-rank percentiles, per-extension and per-format aggregates, triage, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut, shuffle_partitions


def percent(matched: Column, total: Column) -> Column:
    """matched of total in percent, null for nothing."""
    return F.when(total > 0, matched.cast("double") * 100 / total)


def nearest_rank(value: str, p: int) -> Column:
    """The value at place ceil(p * n / 100) of the sorted ones; null of nothing."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})")


def extension(column: str = "ext") -> Column:
    return F.lower(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")))


def ratios(metrics: DataFrame, pairs: dict[str, tuple[str, str]], by: list[Column] | None = None) -> DataFrame:
    """For each name (matched, total columns): sums and percent, over everything or by groups, in one aggregation."""
    sums = metrics.groupBy(*(by or [])).agg(*[F.sum(c).alias(f"{n}_{k}") for n, mt in pairs.items() for k, c in zip(("matched", "total"), mt)])
    return sums.withColumns({f"{n}_percent": percent(F.col(f"{n}_matched"), F.col(f"{n}_total")) for n in pairs})


def nearest_ranks(df: DataFrame, column: str, ranks: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles (name to percent) of a column, by groups, without a task that holds a group's values.

    Equal values are counted first; the counts are range-sorted, each range sums its own, and a range's start is the sum of
    those before it. A percentile is the first value at which the running count reaches its rank.
    """
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counts.repartitionByRange(shuffle_partitions(df), *by, "__v").withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged.withColumn("__g", F.to_json(F.struct(*by)) if by else F.lit("")))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__g", "__part").agg(F.sum("__n").alias("__rows"))  # a row for each group and range
    starts = starts.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn("__all", F.sum("__rows").over(Window.partitionBy("__g")))
    within = F.sum("__n").over(Window.partitionBy("__g", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    running = ranged.withColumn("__in", within).join(starts.drop("__rows"), ["__g", "__part"]).withColumn("__upto", F.col("__start") + F.col("__in"))
    place = lambda p: F.greatest(F.ceil(F.col("__all") * p / 100), F.lit(1))
    first = lambda p: F.when((F.col("__upto") >= place(p)) & (F.col("__upto") - F.col("__n") < place(p)), F.col("__v"))
    return running.groupBy(*by).agg(*[F.max(first(p)).alias(n) for n, p in ranks.items()], F.max("__v").alias("max"))


def latency(metrics: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return nearest_ranks(metrics, column, {"p50": 50, "p95": 95}, by)


def format_coverage(per_file: DataFrame, ranking: DataFrame) -> DataFrame:
    """``per_file`` (file, code, cells, covered) summed by code, files counted, joined to the corpus ranking (code, count),
    ranked: codes of the ranking first, then its count, then cells, then code."""
    by_code = per_file.groupBy("code").agg(F.sum("cells").alias("cells"), F.countDistinct("file").alias("files"), F.sum("covered").alias("covered"))
    joined = by_code.join(ranking.select("code", F.col("count").alias("corpus_count")), "code", "left")
    return joined.withColumn("percent", percent(F.col("covered"), F.col("cells"))).orderBy(F.col("corpus_count").isNotNull().desc(), F.desc_nulls_last("corpus_count"), F.desc("cells"), "code")


def mine_formats(cells: DataFrame, file: str = "file", fmt: str = "fmt") -> DataFrame:
    """(code, cells, files), most cells first, then most files, then code. Files are counted by a partial aggregation over
    (code, file), so a code in every file is no hot group."""
    per = cells.filter(F.col(fmt).isNotNull()).groupBy(F.col(fmt).alias("code"), F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("code").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("files"))
    return out.orderBy(F.desc("cells"), F.desc("files"), "code")


def manifest_summary(entries: DataFrame) -> DataFrame:
    """Rows of (kind, name, files, bytes, distinct_sha, newest): the total, each collection and each extension, in one pass
    over grouping sets. Hashes count among public entries alone; newest is the last fetchedAt, the epoch for none."""
    rolled = entries.withColumn("ext", extension()).groupingSets([[], ["collection"], ["ext"]], "collection", "ext")
    out = rolled.agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct(F.when(~F.col("private"), F.col("sha256"))).alias("distinct_sha"),
        F.coalesce(F.max("fetchedAt"), F.lit("1970-01-01T00:00:00Z")).alias("newest"),
    )
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "collection").otherwise("extension")
    return out.select(kind.alias("kind"), F.coalesce("collection", "ext", F.lit("")).alias("name"), "files", "bytes", "distinct_sha", "newest")


def triage(mismatches: DataFrame, top: int = 20, examples: int = 5) -> DataFrame:
    """``mismatches`` (category, n, path, private): the categories with most, ties by name, with a few public example paths.

    A category's examples are its ``examples`` smallest paths. They come from distinct (category, path) rows ranked with a
    limit that is applied before the shuffle, so no category is collected whole.
    """
    sums = mismatches.groupBy("category").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("private"), F.col("n")).otherwise(0)).alias("private_n"))
    best = sums.orderBy(F.desc("n"), "category").limit(top)
    paths = mismatches.filter(~F.col("private")).select("category", "path").distinct().join(F.broadcast(best.select("category")), "category", "left_semi")
    first = paths.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("path"))).filter(F.col("k") <= examples)
    lists = first.groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return best.join(F.broadcast(lists), "category", "left").select("category", "n", "private_n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


# The start and the factor of the 64-bit hash by which samples are ordered.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def seeded_hash(text: Column, seed: int) -> Column:
    """64-bit FNV-1a of the text's bytes, from the start XOR the seed, as a struct of its two 32-bit halves: it orders like the
    unsigned number, and no product leaves 64 bits."""
    start, low32 = (FNV_OFFSET ^ seed) & 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.floor(F.length(digits) / 2).cast("int")
    places = F.slice(F.sequence(F.lit(0), count), F.lit(1), count)
    half = lambda hi, lo: F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))

    def step(h, at):
        byte = F.conv(F.substring(digits, at * 2 + 1, F.lit(2)), 16, 10).cast("long")
        x = h.lo.bitwiseXOR(byte)
        # The prime is 2**40 + rest: the low half times 2**40 is its shift by 8 in the high half.
        rest = F.lit(FNV_PRIME - (1 << 40))
        low = x * rest
        high = h.hi * rest + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return half(high.bitwiseAND(F.lit(low32)), low.bitwiseAND(F.lit(low32)))

    return F.aggregate(places, half(F.lit(start >> 32), F.lit(start & low32)), step)


def stratified_sample(entries: DataFrame, count: int, seed: int, id_col: str = "id", stratum: str = "ext", max_bytes: int | None = None) -> DataFrame:
    """``count`` entries, taken in turn from the strata (A-Z lower-cased), within a stratum by a seeded hash of the id.

    Only each stratum's first ``count`` can be taken, and Spark's group limit drops the others before the shuffle.
    """
    rows = entries if max_bytes is None else entries.filter(F.col("bytes") <= max_bytes)
    rows = rows.withColumn(stratum, F.translate(stratum, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hashed = rows.withColumn("__h", seeded_hash(F.col(id_col).cast("string"), seed))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", id_col))
    ranked = hashed.withColumn("turn", turn).filter(F.col("turn") <= count).drop("__h")
    return ranked.orderBy("turn", stratum).limit(count)


def first_entries(entries: DataFrame, limit: int, ext: str | None = None, id_col: str = "id") -> DataFrame:
    """The first ``limit`` entries by id, of one extension if it is named."""
    rows = entries if ext is None else entries.filter(extension() == ext)
    return rows.orderBy(id_col).limit(limit)


def markdown_table(df: DataFrame, limit: int = 20) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    show = lambda v: "—" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
