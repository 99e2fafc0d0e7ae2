"""Near-duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. A document's set is its distinct five-word shingles (with fewer words the whole sequence). Documents with equal sets form
   a class; everything after works on classes, so exact copies cost nothing more.
2. ``HASHES`` MinHash values a class; ``BANDS`` bands of ``ROWS`` of them are bucket keys. At similarity 0.75 a pair shares no
   bucket with probability (1 - 0.75**5)**40 = 2e-5.
3. Round one compares every class with the lead (smallest class) of a bucket, the lead with which it shares most buckets: one
   pair a class, whatever the buckets' sizes. Round two takes up what that leaves open, buckets whose classes are in different
   components: every pair across components is compared. A bucket is dealt into parts of about ``PART`` classes, and each pair
   of parts is compared in one block. Parts of a large bucket's largest component are not paired with each other. So no pair
   that shares a bucket is left out, and no pair is a row: a block gives out the classes that have a likely partner in it, gets
   their texts, and gives out the verified links that join components, fewer than its classes.
   The cost is a row for each class and part that it meets: (classes outside the largest component) * classes / PART.
4. Pruning compares signatures in batches. With m agreements of n the posterior of the similarity under a flat prior is
   Beta(m + 1, n - m + 1); a pair is dropped once P(similarity >= 0.75) is under ``MISS``. Set sizes that rule a pair out
   drop it first.
5. Survivors are verified on their whole texts: 100 * |A and B| >= 75 * |A or B|. Hashed shingles may rule a pair out; a link
   is confirmed on the words themselves. The likeliest pairs come first, and what they join need not be verified again.
6. Links make components; the smallest id of each stays.

Edge cases: a null text or one without words has an empty set and no link. Rows that repeat an id are documents of their
own, whatever their texts. A null id takes part like any other and comes after all ids: component_id is null only where a
whole component has no id, and then one text of it is kept. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, lookup, row_key, without_rows
from .components import components, follow

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BATCH = 40
MISS = 1e-5
#: Classes of a part of a bucket, about.
PART = 512
#: Bits of the filter that spares documents without candidates the shuffle of their texts; 512 kB whatever the data.
FILTER_BITS = 1 << 22

_RNG = np.random.default_rng(20_240_229)
_ODD = _RNG.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_LAST = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LINKS = "a long, b long"
BLOCK = ["key", "x", "y", "part", "node", "root", "n_shingles", "sig", "bands"]


class _Words(dict):
    """64-bit hash of a word, by BLAKE2b; a dictionary that starts anew when it holds a quarter of a million words."""

    def __missing__(self, word: bytes) -> int:
        import hashlib

        if len(self) >= 1 << 18:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, hashes: _Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words, hashes = _words(text or ""), _Words() if hashes is None else hashes
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = _mix(out * _LAST[j] + codes[j : len(words) - k + 1 + j])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES linear hashes, half of them of the shingles' low words and half of their high words; a block of
    shingles at a time, so that the table of values stays in the cache."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    half = HASHES // 2
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        for rows, words in ((slice(0, half), part), (slice(half, HASHES), part >> np.uint64(32))):
            table = _ODD[rows] * words.astype(np.uint32)
            table += _ADD[rows]
            np.minimum(out[rows], table.min(1), out=out[rows])
    return out.astype(np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


SKETCH = "doc_id long, row_key binary, n_shingles long, set_key binary, sig binary, bands array<long>"


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    np.seterr(over="ignore")
    words = _Words()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            s = shingle_set(text, words)
            if len(s):
                values = signature(s)
                rows.append((len(s), hashlib.md5(s.tobytes()).digest(), (values & np.uint64(0xFF)).astype(np.uint8).tobytes(), band_keys(values)))
            else:
                rows.append((0, None, None, None))
        out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "sig", "bands"])
        out.insert(0, "row_key", batch["row_key"].to_numpy())
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        yield out


@cache
def least_agreements(n: int, similarity: float = 0.75 + 0.25 / 256, miss: float = MISS) -> int:
    """The fewest agreements of n with P(similarity >= ``similarity``) >= ``miss`` under a flat prior. One byte of each
    MinHash value is compared, which agrees by chance once in 256.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _survivors(sig_a: np.ndarray, sig_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that neither their sizes nor their signatures rule out, batch by batch, with their agreements."""
    near = DENOMINATOR * np.minimum(size_a[i], size_b[j]) >= NUMERATOR * np.maximum(size_a[i], size_b[j])
    i, j = i[near], j[near]
    agreed = np.zeros(len(i), dtype=np.int64)
    for at in range(0, HASHES, BATCH):
        agreed = agreed + (sig_a[i, at : at + BATCH] == sig_b[j, at : at + BATCH]).sum(1)
        keep = agreed >= least_agreements(at + BATCH)
        i, j, agreed = i[keep], j[keep], agreed[keep]
    return i, j, agreed


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), HASHES)


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            each = np.arange(len(batch))
            i, _, _ = _survivors(_signatures(batch["sig_a"]), _signatures(batch["sig_b"]), batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), each, each)
            yield batch.iloc[i][["a", "b"]]


def prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those that sizes and signatures do not rule out."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("n_shingles").alias(f"n_{end}")), end)
    return cut(pairs.mapInPandas(_prune, LINKS))


def same_share(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the shingle sets of two word lists are similar enough, compared word by word without any hashing."""
    k = min(SHINGLE, len(a))
    if not a or k != min(SHINGLE, len(b)):
        return False
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in a + b), dtype=np.int64, count=len(a) + len(b))
    starts = np.concatenate([np.arange(len(a) - k + 1), len(a) + np.arange(len(b) - k + 1)])
    grams, top = codes[starts], len(seen)
    for j in range(1, k):
        if top > (1 << 62) // len(seen):  # number the values anew before they outgrow 64 bits
            values, grams = np.unique(grams, return_inverse=True)
            top = len(values)
        grams, top = grams * len(seen) + codes[starts + j], top * len(seen)
    one, two = np.unique(grams[: len(a) - k + 1]), np.unique(grams[len(a) - k + 1 :])
    both = len(np.intersect1d(one, two, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(one) + len(two) - both)


def _words(text: str) -> list[bytes]:
    """Words of the text; ``bytes`` lower-cases A-Z alone and splits at exactly the six blanks that part words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, held = None, []
    for batch in batches:
        ok = []
        for a, ta, tb in zip(batch["a"], batch["text_a"], batch["text_b"]):
            if a != last:
                last, held = a, _words(ta)
            ok.append(same_share(held, _words(tb)))
        yield batch.loc[ok, ["a", "b"]]


def likely_among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` is not among the values of ``wanted`` (one column). No row that is among
    them is lost. The filter has FILTER_BITS bits, so its broadcast has a fixed size; when it fills up it lets more pass."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    name = wanted.columns[0]
    marks = wanted.select(F.floor(spot(name) / 32768).alias("__k"), F.pmod(spot(name), F.lit(32768)).alias("__b"))
    maps = marks.groupBy("__k").agg(F.bitmap_construct_agg("__b").alias("__map"))
    at = F.pmod(spot(column), F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn("__k", F.floor(spot(column) / 32768)).join(F.broadcast(maps), "__k")
    return held.filter(F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(F.lit(1)) == 1).drop("__k", "__map")


def texts_of(some: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text): one text of each class in ``some`` (node). ``rows``: (row_key, text)."""
    wanted = cut(some.distinct().join(nodes.select("node", F.col("chosen.row_key").alias("row_key")), "node"))
    found = likely_among(rows, "row_key", wanted.select("row_key")).groupBy("row_key").agg(F.first("text").alias("text"))
    return found.join(wanted, "row_key").select("node", "text")


def verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, by the words of one text of each class."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows)
    for end in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return cut(pairs.select("a", "b", "text_a", "text_b").mapInPandas(_verify, LINKS))


def _star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each class b with that lead a of its buckets with which it shares most buckets. a < b, so they make a forest."""
    shared = members.filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("node").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("a"))
    return best.select("a", F.col("node").alias("b"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Chunks of whole blocks (rows with the same key, x and y, which come in order) and the blocks' starts. The rows of a block
    that goes on in the next batch are held: two parts at most."""
    held = None
    for batch in batches:
        chunk = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(chunk):
            continue
        name = chunk[["key", "x", "y"]].to_numpy()
        starts = np.append(0, np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1)
        held = chunk.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield chunk.iloc[: starts[-1]].reset_index(drop=True), starts[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, dtype=np.int64)


def _likely(chunk: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j, agreements) across components of each block that sizes and signatures do not rule out. A pair
    that shares several buckets is met in the first of them alone."""
    sig, bands, size = _signatures(chunk["sig"]), np.stack(chunk["bands"].to_numpy()), chunk["n_shingles"].to_numpy()
    root, key = chunk["root"].to_numpy(), chunk["key"].to_numpy()
    side, one = (chunk["part"] == chunk["x"]).to_numpy(), (chunk["x"] == chunk["y"]).to_numpy()
    counts = np.diff(np.append(starts, len(chunk)))
    block = np.repeat(np.arange(len(starts)), counts)

    def compare(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ok = (root[i] != root[j]) & (one[i] | (side[i] != side[j]))
        i, j, agreed = _survivors(sig, sig, size, size, i[ok], j[ok])
        for at in range(0, len(i), 1 << 15):
            p, q, n = (x[at : at + (1 << 15)] for x in (i, j, agreed))
            first = (bands[p] == bands[q]).argmax(1)
            here = bands[p, first] == key[p]
            yield p[here], q[here], n[here]

    few = counts <= 64
    for apart in range(1, min(64, counts.max(initial=0))):  # small blocks, all at once: each row with the row so many places on
        i = np.flatnonzero((block[:-apart] == block[apart:]) & few[block[:-apart]])
        yield from compare(i, i + apart)
    for at, n in zip(starts[~few], counts[~few]):
        columns, step = np.ascontiguousarray(sig[at : at + n, :BATCH].T), max(1, (1 << 19) // n)
        for first in range(0, n, step):
            agreed = np.zeros((min(step, n - first), n), dtype=np.uint8)
            for c in columns:
                agreed += c[first : first + step, None] == c
            i, j = np.nonzero(agreed >= least_agreements(BATCH))
            later = i + first < j
            yield from compare(at + first + i[later], at + j[later])


def _open_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each block that have a likely partner in it: no more rows than come in."""
    for chunk, starts in _blocks(batches):
        met = np.zeros(len(chunk), dtype=bool)
        for i, j, _ in _likely(chunk, starts):
            met[i] = met[j] = True
        yield chunk[met]


class _Sets:
    """Shingle hashes and words of a chunk's texts, made when asked for; the least lately made go beyond ``ROOM`` words."""

    ROOM = 1 << 22

    def __init__(self, texts: np.ndarray, hashes: _Words):
        self.texts, self.hashes, self.held, self.size = texts, hashes, {}, 0

    def get(self, i: int) -> np.ndarray:
        if i not in self.held:
            while self.held and self.size > self.ROOM:
                self.size -= len(self.held.pop(next(iter(self.held))))
            self.held[i] = shingle_set(self.texts[i], self.hashes)
            self.size += len(self.held[i])
        return self.held[i]

    def linked(self, i: int, j: int) -> bool:
        a, b = self.get(i), self.get(j)
        both = len(np.intersect1d(a, b, assume_unique=True))
        likely = DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)
        return likely and same_share(_words(self.texts[i]), _words(self.texts[j]))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verified links (a, b) that join components of a chunk, fewer than its rows: the likeliest pairs come first, and a pair
    that other links have joined by then need not be verified. What hashes rule out is out; what they leave is held to words."""
    np.seterr(over="ignore")
    hashes = _Words()
    for chunk, starts in _blocks(batches):
        found = list(zip(*_likely(chunk, starts)))
        if not found:
            continue
        i, j, agreed = (np.concatenate(x) for x in found)
        sets, node, root, up, out = _Sets(chunk["text"].to_numpy(), hashes), chunk["node"].to_numpy(), chunk["root"].tolist(), {}, []

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        order = np.argsort(-agreed, kind="stable")
        for p, q in zip(i[order].tolist(), j[order].tolist()):
            one, two = top(root[p]), top(root[q])
            if one != two and sets.linked(p, q):
                up[one] = two
                out.append((min(node[p], node[q]), max(node[p], node[q])))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def links_across(members: DataFrame, roots: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Verified links (a, b) that join what ``roots`` leaves apart: with them, two classes that share a bucket and are similar
    enough are in one component, but for those that pruning misses. ``members``: (key, node) of buckets with two classes or more."""
    met = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    per = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("m")).filter("roots > 1")
    large, parts = F.col("n") > PART, lambda n: F.ceil(n / PART).cast("long")
    own = F.when(large, F.col("m.c")).otherwise(0)
    top = top.select("key", F.when(large, F.col("m.root")).alias("top"), parts(own).alias("own"), parts(F.col("n") - own).alias("others"))
    dealt, spot, is_top = met.join(cut(top), "key"), F.xxhash64("node", F.lit("part")), F.col("root").eqNullSafe(F.col("top"))
    dealt = dealt.withColumn("part", F.when(is_top, F.pmod(spot, "own")).otherwise(F.col("own") + F.pmod(spot, "others")))
    meets = F.explode(F.sequence(F.when(is_top, F.col("own")).otherwise(F.lit(0).cast("long")), F.col("own") + F.col("others") - 1))
    dealt = dealt.select("key", "node", "root", "part", meets.alias("to"))
    dealt = dealt.select("key", F.least("part", "to").alias("x"), F.greatest("part", "to").alias("y"), "part", "node", "root")
    dealt = dealt.join(nodes.select("node", "n_shingles", "sig", "bands"), "node").select(*BLOCK)
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    rest = cut(together(dealt).mapInPandas(_open_rows, dealt.schema))
    if rest.isEmpty():
        return rest.select(F.col("node").alias("a"), F.col("node").alias("b"))
    texts = texts_of(rest.select("node"), nodes, rows)
    return cut(together(rest.join(texts, "node").select(*BLOCK, "text")).mapInPandas(_links, LINKS))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet known to be in one component."""
    for end in ("a", "b"):
        to = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(to, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.filter("root_a <> root_b")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after the verified ``links`` (a, b): components of the graph between the roots, carried to their nodes."""
    met = components(_across(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    up = met.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return cut(old.unionByName(met.join(roots.select("node"), "node", "left_anti")))


def similar_components(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked to another. ``nodes``: (node, sig, bands, n_shingles, chosen)."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    crowds = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter("n > 1").select("key", "lead"))
    members = cut(keys.join(crowds, "key"))
    links = verify(prune(_star_pairs(members), nodes), nodes, rows)
    roots = follow(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    more = links_across(members, roots, nodes, rows)
    return roots if more.isEmpty() else _merged(roots, more)


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_key, chosen): of each row the row of its component that stays, null without words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row_key", row_key("doc_id", "text"))
    base = cut(rows.mapInPandas(_sketch, SKETCH))
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("chosen")
    alike = base.filter("set_key IS NOT NULL").groupBy("set_key")
    classes = alike.agg(pick, F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")])
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = similar_components(nodes.drop("set_key", "n"), rows.select("row_key", "text"))
    linked = cut(roots.join(nodes.select("node", "chosen"), "node"))
    firsts = cut(linked.groupBy("root").agg(F.min("chosen").alias("first"), F.count(F.lit(1)).alias("n")))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in firsts.filter(F.col("n") > total / HOT_SHARE).select("root").collect()]  # < HOT_SHARE
    firsts = lookup(linked.select("node", "root"), firsts.select("root", "first"), "root", hot).select("node", "first")
    groups = nodes.select("set_key", "node", "chosen", "n").join(firsts, "node", "left")
    groups = cut(groups.select("set_key", F.coalesce("first", "chosen").alias("chosen"), "n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in groups.filter(F.col("n") > total / HOT_SHARE).select("set_key").collect()]  # < HOT_SHARE
    keyed = base.select("doc_id", "row_key", "n_shingles", "set_key")
    out = lookup(keyed.filter("set_key IS NOT NULL"), groups.select("set_key", "chosen"), "set_key", hot)
    bare = keyed.filter("set_key IS NULL").withColumn("chosen", F.lit(None).cast(groups.schema["chosen"].dataType))
    return out.unionByName(bare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``id_col``, n_shingles, component_id, kept."""
    rows = _verdicts(docs, id_col, text_col)
    component = F.when(F.col("chosen").isNull(), F.col("doc_id")).otherwise(F.col("chosen.doc_id"))
    alone = F.col("chosen").isNull() | (F.col("chosen.row_key") == F.col("row_key"))
    kept = F.when(component.isNull(), alone).otherwise(F.col("doc_id").eqNullSafe(component))
    return rows.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the one with the smallest id (null last), of these the one with the smallest
    hash of its text. Rows without words stay."""
    rows = _verdicts(docs, id_col, text_col).filter("chosen IS NOT NULL")
    verdict = rows.groupBy("row_key").agg(F.first(F.col("chosen.row_key") == F.col("row_key")).alias("stays"), F.count(F.lit(1)).alias("n"))
    return without_rows(docs, row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut(verdict.filter("NOT stays OR n > 1")))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
