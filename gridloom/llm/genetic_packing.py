"""Best-fit packing by a grouping genetic algorithm over islands.

1. Every document is tokenised (ids, then id 0) and cut from its end into ``capacity``-token pieces; the first piece
   may be shorter. Only the pieces' numbers go on: no text or ids are shuffled.
2. Full pieces are sequences of their own. The others are dealt to blocks of about ``BLOCK`` pieces by hash, so a block
   fits in a task however much data there is.
3. A block is solved by ``ISLANDS`` populations. A solution's genes are whole bins. Crossover injects the other
   parent's best-filled bins, bins that would repeat a piece are dissolved, and displaced pieces are put back best fit
   first. After each epoch every island's elite moves to the next island of the ring (an exchange on (block, island)).
4. The best solution's bins that are nearly full stay; pieces of the others of all blocks meet again in new, fewer
   blocks, until one block is left or a pass leaves over nine tenths of its pieces (such as those of which no two fit
   together); so loose ends do not add up with the number of blocks. Each pass has at most nine tenths of the one before.

Equal pieces (id, piece, length, sum) are counted before they are numbered, and blocks and their order come from hashes of a
piece and its number, so that the packing does not depend on how the rows were partitioned.

Edge cases: a null or empty text is one piece of length 1 (id 0); a null id is an id; repeated rows are packed as often
as they come; an empty table gives an empty result; other columns are not looked at. Results repeat from run to
run, whatever the partitions, but for the numbers of sequences of full pieces.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
#: Pieces in a block, populations of a block, solutions of a population, epochs, crossovers of an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 2048, 2, 4, 2, 4
#: A bin filled to this share stays; the pieces of the others are packed again with other blocks'.
FULL = 0.995
#: A pass that leaves more than this share of its pieces in loose bins is the last.
HELPS = 0.9
#: Equal pieces are numbered in runs of so many.
RUN = 1 << 16
#: Words whose ids a task remembers at most.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker: loading takes longer than a small task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Little-endian 32-bit ids of texts, equal to those of the tokenizer file, remembering words.

    A space before a non-space always begins a new pre-token of this vocabulary's pattern, so a text without doubled,
    trailing or newline-adjoining spaces splits into words that can be encoded on their own; other texts are
    encoded whole. Where every merge makes the next id, the merges are the ids' order, and the faster of the two
    libraries gives the same ids. A text that holds an added token's string goes to the tokenizer itself.
    """

    _loose = re.compile(r" (?:\s|$)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._fast = self._ranked(path, set(added))
        owner = self

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = ids = owner._encode(word)
                return ids

        self._words = Words()

    @staticmethod
    def _ranked(path: str, added: set[str]):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_alphabet()
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        if made != list(range(256, 256 + len(made))):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, text: str) -> bytes:
        if self._fast is None:
            return self._slow(text)
        ids = self._fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self._added and self._added.search(text):
            return self._slow(text)
        if self._loose.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        words = self._words
        return words[first] + b"".join([words[" " + w] for w in rest])


def cut_pieces(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``tokens`` ids: full ones from the end, a shorter one first."""
    first = tokens % capacity or min(tokens, capacity)
    starts = [0, *range(first, tokens, capacity)]
    return [(s, (first if s == 0 else capacity)) for s in starts]


def piece_rows(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                raw = (encode(text) if text else b"") + b"\0\0\0\0"
                for k, (start, length) in enumerate(cut_pieces(len(raw) // 4, capacity)):
                    ids.append(doc)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "piece": pieces, "start": starts, "length": lengths, "ids_crc32": sums})

    return run


def best_fit(items: list[int], size: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items``, longest first, each into the open bin that it fills best; ``bins`` and ``room`` grow."""
    open_bins = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect_left(open_bins, (size[i], -1))
        if at == len(open_bins):
            k, left = len(bins), capacity - size[i]
            bins.append([i])
            room.append(left)
        else:
            left, k = open_bins.pop(at)
            left -= size[i]
            bins[k].append(i)
            room[k] = left
        if left:
            insort(open_bins, (left, k))


class Population:
    """Solutions of one block on one island; a solution is a list of bins, a bin a list of the block's item numbers."""

    def __init__(self, size: list[int], capacity: int, seed: int):
        self.size, self.capacity, self.rng = size, capacity, random.Random(seed)

    def room(self, bins: list[list[int]]) -> list[int]:
        return [self.capacity - sum(self.size[i] for i in b) for b in bins]

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones: loose space in one bin is easier to use."""
        return (-len(bins), sum((1 - r / self.capacity) ** 2 for r in self.room(bins)))

    def start(self, count: int) -> list[list[list[int]]]:
        """Best fit decreasing, then best fit of items in part shuffled."""
        out = []
        for k in range(count):
            bins, room = [], []
            if k == 0:
                best_fit(list(range(len(self.size))), self.size, bins, room, self.capacity)
            else:
                loose = self.rng.sample(range(len(self.size)), len(self.size) // 3)
                taken = set(loose)
                best_fit([i for i in range(len(self.size)) if i not in taken], self.size, bins, room, self.capacity)
                best_fit(loose, self.size, bins, room, self.capacity)
            out.append(bins)
        return out

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """``a`` with well-filled bins of ``b`` injected; bins of ``a`` that share an item go, and what they held
        besides is placed best fit."""
        order = sorted(zip(self.room(b), range(len(b))))[: max(1, len(b) // 2)]
        chosen = self.rng.sample(order, max(1, len(order) // 2))
        injected = [b[k] for _, k in chosen]
        held = {i for x in injected for i in x}
        kept, displaced = [], []
        for x in a:
            if held.isdisjoint(x):
                kept.append(x)
            else:
                displaced += [i for i in x if i not in held]
        bins = [list(x) for x in (*injected, *kept)]
        room = self.room(bins)
        worst = sorted(range(len(bins)), key=lambda k: -room[k])[: max(1, len(bins) // 50)]  # mutation: dissolve the emptiest
        displaced += [i for k in worst for i in bins[k]]
        gone = set(worst)
        bins, room = [x for k, x in enumerate(bins) if k not in gone], [r for k, r in enumerate(room) if k not in gone]
        best_fit(displaced, self.size, bins, room, self.capacity)
        return bins

    def evolve(self, members: list[list[list[int]]], crossovers: int) -> list[list[list[int]]]:
        """Best first. Stops where no solution can have fewer bins."""
        least = -(-sum(self.size) // self.capacity)
        scored = sorted(((self.fitness(m), k, m) for k, m in enumerate(members)), key=lambda x: (x[0], -x[1]), reverse=True)
        for n in range(crossovers):
            if -scored[0][0][0] <= least:
                break
            a, b = self.rng.choice(scored[: max(2, len(scored) // 2)]), self.rng.choice(scored)
            child = self.cross(a[2], b[2])
            scored.append((self.fitness(child), 1000 + n, child))
            scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[: max(2, len(members))]
        return [m for _, _, m in scored]


def encode_bins(bins: list[list[int]], count: int) -> list[int]:
    """The bin of each item."""
    out = [0] * count
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def decode_bins(places: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(places):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


def epoch(capacity: int, population: int, crossovers: int, number: int):
    """Rows of (block, island, uids, sizes, members, migrant): evolves each population, with the migrant among it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                size = [int(x) for x in row.sizes]
                p = Population(size, capacity, hash((int(row.block), int(row.island), number)))
                members = [decode_bins(m) for m in row.members] if row.members is not None and len(row.members) else p.start(population)
                if row.migrant is not None:
                    members[-1:] = [decode_bins(row.migrant)]
                members = p.evolve(members, crossovers)
                fit = p.fitness(members[0])
                out.append((row.block, row.island, row.uids, row.sizes, [encode_bins(m, len(size)) for m in members], -fit[0], fit[1]))
            yield pd.DataFrame(out, columns=["block", "island", "uids", "sizes", "members", "bins", "evenness"])

    return run


EPOCH = "block long, island int, uids array<long>, sizes array<int>, members array<array<int>>, bins long, evenness double"


def solve(items: DataFrame, blocks: int, capacity: int = CAPACITY, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """``items`` (uid, tag, length) with block and bin, and a new tag: the best solution that any island found for each block."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("tag", F.lit(blocks)), F.lit(blocks)))
    grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("tag", "length", "uid"))).alias("x"))  # about BLOCK items
    state = grouped.select(
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("x.uid").alias("uids"),
        F.col("x.length").cast("array<int>").alias("sizes"),
        F.lit(None).cast("array<array<int>>").alias("members"),
        F.lit(None).cast("array<int>").alias("migrant"),
    )
    for n in range(epochs):
        evolved = cut(state.repartition("block", "island").mapInPandas(epoch(capacity, population, crossovers, n), EPOCH))
        if n + 1 < epochs:
            elite = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.element_at("members", 1).alias("migrant"))
            state = evolved.join(elite, ["block", "island"]).select("block", "island", "uids", "sizes", "members", "migrant")
    best = evolved.groupBy("block").agg(F.min(F.struct("bins", (-F.col("evenness")).alias("e"), "island")).alias("b"))
    best = best.select("block", F.col("b.island").alias("island"))
    chosen = evolved.join(best, ["block", "island"])
    placed = chosen.select("block", F.posexplode(F.arrays_zip("uids", "sizes", F.element_at("members", 1).alias("bin"))).alias("at", "z"))
    return placed.select("block", F.col("z.uids").alias("uid"), F.xxhash64("block", "at").alias("tag"), F.col("z.sizes").alias("length"), F.col("z.bin").alias("bin"))


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(piece_rows(tokenizer or default_tokenizer(), capacity), PIECES)


def numbered_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` with uid, a handle of each row, and tag, a hash that depends on the piece and on its number among equal ones."""
    columns = pieces.columns
    counted = cut(pieces.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")))
    most = counted.agg(F.max("__n")).first()[0] or 0
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))))
    if most > RUN:
        runs = runs.repartition("__run", *columns)
    last = F.least(F.col("__n"), (F.col("__run") + 1) * RUN) - 1
    each = runs.withColumn("__at", F.explode(F.sequence(F.col("__run") * RUN, last)))
    return each.select(*columns, F.xxhash64(*columns, "__at").alias("tag"), F.monotonically_increasing_id().alias("uid"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(numbered_pieces(tokenised_pieces(docs, id_col, text_col, tokenizer, capacity)))
    rest = pieces.filter(F.col("length") < capacity).select("uid", "tag", "length")
    count, done, base = rest.count(), None, 0
    while count:
        blocks = max(1, -(-count // block))
        placed = cut(solve(rest, blocks, capacity))
        fill = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("tag", "length", "uid"))).alias("x"))
        loose = cut(fill.filter(F.col("fill") < FULL * capacity).select(F.explode("x").alias("p")).select("p.uid", "p.tag", "p.length"))
        left = 0 if blocks == 1 else loose.count()
        last = blocks == 1 or left > HELPS * count
        stays = fill if last else fill.filter(F.col("fill") >= FULL * capacity)
        offsets = F.transform("x", lambda p, i: F.struct(p.uid.alias("uid"), F.aggregate(F.slice("x", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y.length).alias("offset")))
        # The number of a sequence: blocks of earlier passes and this one's, and the bin (a block has far fewer than 2**20 bins).
        number = (F.lit(base).cast("long") + F.col("block")) * F.lit(1 << 20) + F.col("bin")
        kept = stays.select(number.alias("sequence_id"), F.explode(offsets).alias("o")).select("sequence_id", F.col("o.uid").alias("uid"), F.col("o.offset").alias("offset"))
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rest, count, base = loose, left, base + blocks
    full = pieces.filter(F.col("length") >= capacity)
    out = full.withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    if done is not None:
        out = out.unionByName(pieces.filter(F.col("length") < capacity).join(done, "uid"))
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
