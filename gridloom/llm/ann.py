"""Approximate nearest neighbours on shifted space-filling curves.

1. Equal vectors form a class; a class keeps its k + 1 smallest ids, which is all that a result can need of it.
2. Unit vectors are projected to ``PROJECTED`` dimensions, shifted, and put on a Hilbert curve; ``CURVES`` such orderings
   differ in projection and shift. Each is range-partitioned into blocks of about ``BLOCK`` rows; queries are sorted in.
3. A query meets the blocks within a window of its own on each curve; candidates of all curves merge and are ranked by
   their exact cosine.
4. How many curves and how wide a window is fitted: for ``FIT_QUERIES`` queries (a fixed bound) the true neighbours are
   found against all rows in blocks, and the cheapest setting that would have met ``RECALL`` of them is taken. Every
   row is indexed. Vectors without structure make the window wide, up to all blocks; clustered ones keep it narrow.
5. A block meets its queries ``QUERIES`` at a time at most on average; products of whole matrices choose, exact cosines decide.

Vectors are scaled by a power of two to components of at most 1 first, which leaves every cosine as it is and keeps squares
of very large or very small numbers from overflowing or vanishing.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as query nor as candidate; a null id takes no part; rows that repeat an id and vector are one; fewer
than k candidates give fewer rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, lookup

CURVES, PROJECTED, BITS, BLOCK, QUERIES = 3, 8, 7, 2048, 4096
#: Distinct vectors that a task holds at once while it gathers their ids.
HELD = 1 << 15
FIT_QUERIES, RECALL = 64, 0.96


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (rows, each coordinate under 2**bits) on the Hilbert curve: the coordinates are
    turned level by level from the highest bit, then Gray-decoded and interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def projections(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directions, shift) of each curve, the same in every run."""
    rng = np.random.default_rng(7 + dim)
    n = min(PROJECTED, dim)
    return [(np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :n], rng.uniform(-0.1, 0.1, n)) for _ in range(CURVES)]


def curve_keys(unit: np.ndarray, directions: np.ndarray, shift: np.ndarray) -> np.ndarray:
    cell = (unit @ directions) * np.sqrt(unit.shape[1]) / 6 + 0.5 + shift
    return hilbert_keys(np.clip((cell * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def scaled(vector: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component to between 1/2 and 1."""
    return np.ldexp(vector, -int(np.frexp(np.abs(vector).max())[1]))


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of one vector with each row, each from its own two vectors alone whatever else is in the block."""
    return np.array([float(np.sum(q * r)) / (float(np.sqrt(np.sum(q * q))) * float(np.sqrt(np.sum(r * r)))) for r in rows])


def nearest_rows(queries: np.ndarray, rows: np.ndarray, reps: np.ndarray, count: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, exact cosine) of the ``count`` nearest rows of each query, ties by rep. Products choose generously, exact
    cosines decide."""
    unit = (rows / np.sqrt((rows * rows).sum(1, keepdims=True))).T
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        rough = some / np.sqrt((some * some).sum(1, keepdims=True)) @ unit
        edges = np.partition(rough, -count, axis=1)[:, -count] if len(rows) > count else np.full(len(some), -2.0)
        for n, (q, near, edge) in enumerate(zip(some, rough, edges)):
            chosen = np.flatnonzero(near >= edge - 1e-9)
            exact = cosines(q, rows[chosen])
            for i in np.lexsort((reps[chosen], -exact))[:count]:
                yield at + n, int(chosen[i]), float(exact[i])


CLASS = "vkey binary, ids array<long>, q boolean, vec binary"


def _classes(count: int):
    """A row for each distinct vector that the task holds at a time, with its ``count`` smallest ids."""

    def rows(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(k, sorted(-i for i in ids), q, a.tobytes()) for k, (a, ids, q) in held.items()], columns=["vkey", "ids", "q", "vec"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for i, q, v in zip(batch["vec_id"], batch["q"], batch["v"]):
                a = np.asarray(v, dtype="<f8")
                own = held.setdefault(hashlib.md5(a.tobytes()).digest(), [scaled(a), [], False])
                own[2] |= bool(q)
                if i is not None and i == i and -int(i) not in own[1]:
                    (heapq.heappush if len(own[1]) < count else heapq.heappushpop)(own[1], -int(i))
            if len(held) >= HELD:
                yield rows(held)
                held = {}
        yield rows(held)

    return run


def _keys(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit = np.frombuffer(b"".join(batch["vec"]), dtype="<f8").reshape(len(batch), dim)
            unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
            for c, (directions, shift) in enumerate(projections(dim)):
                yield batch.assign(curve=c, key=curve_keys(unit, directions, shift))

    return run


def _true_neighbours(vkeys: list[bytes], queries: np.ndarray, count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = np.frombuffer(b"".join(batch["vec"]), dtype="<f8").reshape(len(batch), queries.shape[1])
            reps = np.array([int(x[0]) for x in batch["ids"]])
            keys = list(batch["vkey"])
            rows = [(vkeys[n], keys[i], int(reps[i]), s) for n, i, s in nearest_rows(queries, m, reps, count)]
            yield pd.DataFrame(rows, columns=["qkey", "vkey", "rep", "score"])

    return run


def _search(dim: int, count: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame([], columns=["qkey", "ids", "score"])  # untyped columns turn into any Arrow type
        m = np.frombuffer(b"".join(rows["vec"]), dtype="<f8").reshape(len(rows), dim)
        asked = np.frombuffer(b"".join(queries["vec"]), dtype="<f8").reshape(len(queries), dim)
        reps, ids, names = np.array([int(x[0]) for x in rows["ids"]]), list(rows["ids"]), list(queries["vkey"])
        out = [(names[n], ids[i], s) for n, i, s in nearest_rows(asked, m, reps, count)]
        return pd.DataFrame(out, columns=["qkey", "ids", "score"])

    return run


def choose(gaps: dict[tuple, dict[int, int]], blocks: dict[int, int], recall: float = RECALL) -> tuple[int, int]:
    """(curves, window) with the fewest blocks a query that meets ``recall`` of the pairs in ``gaps``: for each true
    pair its distance in blocks on each curve."""
    width = max(blocks.values(), default=1)
    options = [(min(n * (2 * w + 1), n * width), n, w) for n in range(1, len(blocks) + 1) for w in range(width)]
    for _, n, w in sorted(options):
        met = sum(min(g.get(c, width) for c in range(n)) <= w for g in gaps.values())
        if met >= recall * len(gaps):
            return n, w
    return len(blocks), width


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` to each row of ``queries``, other than the row itself."""
    spark = vectors.sparkSession

    def sound(df: DataFrame, query: bool) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(query).alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))

    data, asked = sound(vectors, False), sound(queries, True)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return empty
    dim = dims[0]["d"]
    data, asked = data.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    parts = data.select("vec_id", "q", "v").unionByName(asked.select(F.lit(None).cast("long").alias("vec_id"), "q", "v"))
    parts = parts.mapInPandas(_classes(k + 1), CLASS)
    classes = cut(
        parts.groupBy("vkey").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.max("q").alias("q"), F.first("vec").alias("vec"))
    )
    n = classes.count()
    if not n:
        return empty

    placed = classes.mapInPandas(_keys(dim), CLASS + ", curve int, key long")
    placed = placed.repartitionByRange(max(1, CURVES * -(-n // block)), "curve", "key", "vkey").withColumn("__pid", F.spark_partition_id())
    placed = cut(placed)
    spans = {r[0]: (r[1], r[2]) for r in placed.groupBy("curve").agg(F.min("__pid"), F.max("__pid")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for c, (a, _) in spans.items() for x in (c, a)]), F.col("curve"))
    placed = placed.withColumn("block", F.col("__pid") - first).drop("__pid", "key")
    blocks = {c: b - a + 1 for c, (a, b) in spans.items()}

    fit = classes.filter("q").orderBy(F.xxhash64("vkey")).limit(FIT_QUERIES).collect()
    if not fit:
        return empty
    keys = [bytes(r["vkey"]) for r in fit]
    matrix = np.array([np.frombuffer(r["vec"], dtype="<f8") for r in fit])
    near = classes.filter(F.size("ids") > 0).mapInPandas(_true_neighbours(keys, matrix, k + 1), "qkey binary, vkey binary, rep long, score double")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "rep")
    near = near.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k + 1).filter("qkey <> vkey").select("qkey", "vkey").collect()
    wanted = spark.createDataFrame([(x,) for x in {*keys, *(bytes(r["vkey"]) for r in near)}], "vkey binary")  # at most (k + 2) * FIT_QUERIES
    at = {(bytes(r["vkey"]), r["curve"]): r["block"] for r in placed.join(F.broadcast(wanted), "vkey").select("vkey", "curve", "block").collect()}
    pairs = [(bytes(r["qkey"]), bytes(r["vkey"])) for r in near]
    gaps = {(a, b): {c: abs(at[a, c] - at[b, c]) for c in blocks} for a, b in pairs}
    curves, window = choose(gaps, blocks)

    rows = placed.filter((F.col("curve") < curves) & (F.size("ids") > 0)).select("curve", "block", "ids", "vec")
    last = F.element_at(F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b - 1)]), F.col("curve"))
    reach = F.sequence(F.greatest(F.lit(0), F.col("block") - window), F.least(last, F.col("block") + window))
    sent = placed.filter((F.col("curve") < curves) & F.col("q")).select("curve", F.explode(reach).alias("block"), "vkey", "vec")
    most = sent.groupBy("curve", "block").count().agg(F.max("count")).first()[0] or 0
    deals = -(-most // QUERIES)  # a block's queries in so many parts, its rows once with each
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(max(0, deals - 1)))))
    sent = sent.withColumn("deal", F.pmod(F.xxhash64("vkey"), F.lit(max(1, deals))).cast("int"))
    met = ["curve", "block", "deal"]
    found = rows.groupBy(*met).cogroup(sent.groupBy(*met)).applyInPandas(_search(dim, k + 1), "qkey binary, ids array<long>, score double")
    found = found.select("qkey", F.explode("ids").alias("vec_id"), "score").distinct()
    w = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k + 1)
    lists = found.groupBy(F.col("qkey").alias("vkey")).agg(F.array_sort(F.collect_list(F.struct("__r", "vec_id", "score"))).alias("near"))

    ids = cut(asked.select("vec_id", "v").mapInPandas(_query_keys, "query_id long, vkey binary").distinct())
    out = lookup(ids, cut(lists), "vkey", hot_keys(ids, "vkey"), "inner")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _query_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"query_id": batch["vec_id"], "vkey": [hashlib.md5(np.asarray(v, dtype="<f8").tobytes()).digest() for v in batch["v"]]})
