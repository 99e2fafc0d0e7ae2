"""Near-duplicates, packing, licences, neighbours and the fitted models against brute force and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, bayes_dedup, components, curriculum, genetic_packing, licences, quality, toxicity
from gridloom.llm.common import ready

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_rows():
    """Families of near copies, one of them large and loose, documents that share a passage, and odd ones."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for copies, edits in ((60, 5), (4, 2), (2, 1), (25, 3)):
        texts += family(rng, words, [rng.choice(words) for _ in range(120)], copies, edits)
    passage = [rng.choice(words) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(60)]) for _ in range(40)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += ["", None, "  \t ", "One two", "one TWO", "one two three", "É x y z q", "é x y z q", texts[0], texts[0].upper(), "long " * 20000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, near_rows):
    docs = spark.createDataFrame([(i, t, "e") for i, t in near_rows], "doc_id long, text string, component_id string")
    ready(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bayes_dedup.near_duplicates(docs).collect()}
    want = brute_components(near_rows)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(k == (i == c) for i, (_, c, k) in got.items())
    left = bayes_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({c for _, c in want.values()})


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None), (None, "only without id x y z"), (None, "ONLY without id x y z")], "doc_id long, text string")
    got = Counter(tuple(r) for r in bayes_dedup.near_duplicates(docs).collect())
    assert got == {(None, 2, 1, False): 1, (1, 2, 1, True): 2, (2, 0, 2, True): 1, (None, 0, None, True): 1, (None, 2, None, True): 1, (None, 2, None, False): 1}
    assert bayes_dedup.near_duplicates(docs.limit(0)).count() == 0
    left = Counter(r.doc_id for r in bayes_dedup.drop_near_duplicates(docs).collect())
    assert left == {1: 1, 2: 1, None: 2}
    assert bayes_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    """Twenty ids with two texts each, the second near to a text of another id: every link is found, every other text stays."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(20):
        base = [rng.choice(words) for _ in range(80)]
        near = list(base)
        near[3] = "changed"
        rows += [(k, " ".join(rng.choice(words) for _ in range(50))), (k, " ".join(near)), (1000 + k, " ".join(base)), (5000, " ".join(rng.choice(words) for _ in range(30)))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string")
    ready(spark)
    got = {r.doc_id: r.component_id for r in bayes_dedup.near_duplicates(docs).collect() if r.doc_id >= 1000}
    assert got == {**{1000 + k: k for k in range(20)}, 5000: 5000}
    left = Counter((r.doc_id, r.text) for r in bayes_dedup.drop_near_duplicates(docs).collect())
    assert left == Counter(r for r in rows if not 1000 <= r[0] < 1020)


def test_crowded_buckets_lose_nothing(spark, near_rows, monkeypatch):
    """Parts of large buckets: every component as by brute force, with many parts a bucket."""
    monkeypatch.setattr(bayes_dedup, "PART", 8)
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in bayes_dedup.near_duplicates(docs).collect()}
    assert got == {i: root for i, (_, root) in brute_components(near_rows).items()}


def test_shares_of_words():
    """The exact comparison agrees with sets of word tuples, also where codes outgrow 64 bits and at the threshold."""
    rng = random.Random(3)
    for vocabulary in (2, 30, 100_000):
        for _ in range(60):
            a = [b"%d" % rng.randrange(vocabulary) for _ in range(rng.randint(0, 60))]
            b = [w if rng.random() > 0.02 else b"%d" % rng.randrange(vocabulary) for w in a][: rng.randint(0, 70)]
            one, two = (shingles(" ".join(x.decode() for x in w)) for w in (a, b))
            both = len(one & two)
            assert bayes_dedup.same_share(a, b) == (both > 0 and 100 * both >= 75 * len(one | two))
    long = [b"%d" % k for k in range(9000)]
    assert bayes_dedup.same_share(long, long[:8000]) and not bayes_dedup.same_share(long, long[:6000])


def test_twins_among_texts_of_a_template(spark):
    """320 texts that are 0.71 alike by a common template, 40 pairs of them 0.755 to 0.775 alike."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    template, texts = some(200), []
    for k in range(40):
        twin = some(7 + k % 4)
        texts += [template + twin + some(40 - len(twin)) for _ in range(2)]
    texts += [template + some(40) for _ in range(240)]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = {i: root for i, (_, root) in brute_components(rows).items()}
    assert len(set(want.values())) == 280
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ready(spark)
    assert {r.doc_id: r.component_id for r in bayes_dedup.near_duplicates(docs).collect()} == want


def test_posterior_bound():
    """The bound keeps a pair at the threshold but for the stated chance, and prunes unlike pairs early."""
    n = bayes_dedup.BATCH
    assert bayes_dedup.least_agreements(n) < 0.6 * n
    rng = np.random.default_rng(1)
    assert (rng.binomial(bayes_dedup.HASHES, 0.75, 20000) >= bayes_dedup.least_agreements(bayes_dedup.HASHES)).mean() > 0.9995
    assert (rng.binomial(n, 0.2, 2000) < bayes_dedup.least_agreements(n)).mean() > 0.99


def test_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bayes_dedup, "FILTER_BITS", 1 << 17)
    ids = spark.range(50_000).select((F.col("id") * 7).alias("node"))
    wanted = ids.filter("node % 700 = 0")
    left = bayes_dedup.likely_among(ids, "node", wanted)
    assert left.join(wanted, "node", "left_semi").count() == wanted.count() and left.count() < 3 * wanted.count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7), (5, 0)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got[x] == find(x) for e in edges for x in e if e[0] != e[1])


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["plain", "Words,", "naïve", "x1y", "\n\nend", "日本"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    texts += [None, "", "a <|endoftext|> b", "  two  spaces ", "tab\t \n mix", "word " * 6000]
    rows = list(enumerate(texts)) + [(None, "no id"), (0, texts[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    ready(spark)
    got = genetic_packing.pack(docs, block=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        first = len(ids) % 2048 or min(2048, len(ids))
        for k, n in enumerate([first] + [2048] * ((len(ids) - first) // 2048)):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert genetic_packing.pack(docs.limit(0)).count() == 0


def test_genetic_steps_keep_items():
    rng = random.Random(4)
    size = [rng.randint(1, 900) for _ in range(200)]
    p = genetic_packing.Population(size, 1000, 1)
    members = p.start(4)
    child = p.cross(members[0], members[1])
    assert sorted(i for b in child for i in b) == list(range(200)) and min(p.room(child)) >= 0
    best = p.evolve(members, 20)[0]
    assert p.fitness(best) >= max(map(p.fitness, members))
    assert genetic_packing.decode_bins(genetic_packing.encode_bins(best, 200)) and len(best) >= -(-sum(size) // 1000)


BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def test_licences(spark):
    rng = random.Random(6)
    bits = ["under the MIT license", "Apache License, Version 2.0", "CC-BY-NC", "under the", "mit", "license version 2", "cc by", "GNU General Public License version 3", "über", "apache  license\nversion 20", "Under The Mit Licenses"]
    texts = [" ".join(rng.choice(bits + ["word", "x", "1"]) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "under the mit license under the mit license"]
    rows = list(enumerate(texts)) + [(None, "cc by nc")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    ready(spark)
    got = {r.doc_id: r for r in licences.digest(licences.scan(docs)).collect()}
    for i, text in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))
        at = [(k, n) for n, p in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({n for _, n in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        gpl = "gnu general public license version 3" in " ".join(w)
        assert set(r.labels.split(",")) - {""} == {n for _, n in at} | ({"gpl-3"} if gpl else set())
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licences.digest(licences.scan(docs.limit(0))).count() == 0


def test_licence_with_changed_words():
    text = "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation file"
    index = licences.Index(licences.BASE + licences.MORE, {w: 1.0 for t in licences.BASE + licences.MORE for w in t.words})
    (hit,) = index.find(licences.Words(text))
    assert index.templates[hit[0]].label == "mit" and hit[1] == 0 and 0.7 <= hit[3] < 1
    assert not index.find(licences.Words(text.replace("free of charge", "free charge")))


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 1500)] + 0.2 * rng.standard_normal((1500, 24))).astype(np.float32)
    x[100:160] = x[5]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 3), (None, x[0].tolist()), (5200, [1.0] * 23 + [None]), (7, x[7].tolist())]
    data = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    ready(spark)
    got = defaultdict(list)
    for r in ann.nearest(data, data.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 50):
        own = sorted(got[q])
        s = np.array([float(np.sum(y[q] * v) / (np.sqrt(np.sum(y[q] * y[q])) * np.sqrt(np.sum(v * v)))) for v in y])
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5]
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in own)
        hit += len({i for _, i, _ in own} & set(want.tolist()))
    assert hit >= 0.9 * 150 and set(got) == set(range(0, 1500, 50))
    assert [i for _, i, _ in sorted(got[100])] == [5, 101, 102, 103, 104]
    assert ann.nearest(data.limit(0), data).count() == 0


def test_neighbours_through_narrow_windows(spark, monkeypatch):
    """Clustered vectors in blocks of 64 and queries in parts: several blocks stay unseen, recall is kept."""
    rng = np.random.default_rng(18)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 24))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ready(spark)
    chosen, choose = [], ann.choose
    monkeypatch.setattr(ann, "choose", lambda gaps, blocks: chosen.append((blocks, choose(gaps, blocks))) or chosen[-1][1])
    monkeypatch.setattr(ann, "QUERIES", 7)
    got = defaultdict(set)
    for r in ann.nearest(data, data.filter("vec_id % 20 = 0"), block=64).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit[::20] @ unit.T
    hit = 0
    for n, q in enumerate(range(0, 3000, 20)):
        near[n, q] = -9
        hit += len(set(np.argsort(-near[n])[:5].tolist()) & got[q])
    blocks, (curves, window) = chosen[0]
    assert min(blocks.values()) > 20 and curves * (2 * window + 1) <= 0.5 * max(blocks.values()) and hit >= 0.9 * 750


def test_neighbours_of_very_large_and_small_numbers(spark):
    """Squares would overflow or vanish; scores are those of the vectors scaled to one. Few candidates give few rows."""
    rows = [(0, [1e200, 2e200]), (50, [1e-170, 2e-170]), (1, [3e300, -1e300]), (2, [5e-324, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ready(spark)
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 12)) for r in ann.nearest(data, data.filter("vec_id % 50 = 0")).collect()}
    low, side = round(1 / 50**0.5, 12), round(1 / 5**0.5, 12)
    assert got == {(0, 1): (50, 1.0), (0, 2): (2, side), (0, 3): (1, low), (50, 1): (0, 1.0), (50, 2): (2, side), (50, 3): (1, low)}


def test_hilbert_steps_are_neighbours():
    """Along the curve each step changes one coordinate by one, and every cell is met once."""
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = ann.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_quality_on_labels(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    ready(spark)
    got = quality.weak_label_quality(spark.read.parquet(f"{base}/documents.parquet"))
    rows = got.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "  \n", "s"), (None, "A fine sentence of words, as people write them here.", "s"), (4, "x", "s")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in quality.weak_label_quality(docs).collect()}
    assert len(got) == 5 and not any(got[k].keep for k in (1, 2, 3))
    assert quality.weak_label_quality(docs.limit(0)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_em_finds_accuracies():
    rng = np.random.default_rng(9)
    good = rng.random(20000) < 0.8
    votes = np.full((20000, 4), np.nan)
    for k, (g, b) in enumerate(((0.97, 0.6), (0.95, 0.8), (0.9, 0.5), (0.99, 0.7))):
        right = np.where(good, rng.random(20000) < g, rng.random(20000) < b)
        votes[:, k] = np.where(rng.random(20000) < 0.9, np.where(right, good, ~good), np.nan)
    counts = Counter(tuple(None if v != v else int(v) for v in r) for r in votes)
    share, sure_good, sure_bad = quality.estimate([(p, float(n)) for p, n in counts.items()])
    assert abs(share - 0.8) < 0.03 and np.allclose(sure_good, [0.97, 0.95, 0.9, 0.99], atol=0.03) and np.allclose(sure_bad, [0.6, 0.8, 0.5, 0.7], atol=0.08)


def test_toxicity_held_out(spark):
    rng = random.Random(10)
    words, bad = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)], ["vile", "awful", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = [rng.choice(words) for _ in range(60)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 12 != 0), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "plain"), (9000, None)], "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ready(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, truth.filter("doc_id < 800").unionByName(spark.createDataFrame([(None, None, 1)], truth.schema))).collect()}
    test = [(got[i].toxic, i % 6 == 0) for i in range(800, 1200)]
    assert sum(p and t for p, t in test) >= 0.95 * sum(t for _, t in test) and sum(p and not t for p, t in test) <= 3
    assert not got[9000].toxic and not got[None].toxic
    none = toxicity.classify(docs, truth.limit(0)).collect()
    assert len(none) == 1202 and not any(r.toxic for r in none)
    assert toxicity.classify(docs.limit(0), truth).count() == 0


def test_toxicity_of_every_language(spark):
    """Four vocabularies, three of them with 15 % of the documents each: held-out recall of at least 0.9 in each."""
    rng = random.Random(31)
    rows, labels = [], []
    tongues = [([f"{t}{k}x" for k in "abcdefghijklmnopqrstuvwxyz" * 12], [f"{t}bad{k}" for k in "abcdef"]) for t in ("one", "two", "three", "four")]
    for i in range(6000):
        tongue = rng.choices(range(4), (55, 15, 15, 15))[0]
        words, bad = tongues[tongue]
        words = [f"{w}{k % 9}" for k, w in enumerate(words)]
        toxic = rng.random() < 0.1
        w = [rng.choice(words) for _ in range(50)] + [rng.choice(bad) for _ in range(3 * toxic)]
        rng.shuffle(w)
        rows.append((i, " ".join(w).translate(str.maketrans("012345678", "qwertyuio")), tongue, toxic))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    truth = spark.createDataFrame(labels[:4000], "doc_id long, quality int, toxic int")
    ready(spark)
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs, truth).collect()}
    for t in range(4):
        found = [got[i] for i, _, tongue, toxic in rows[4000:] if tongue == t and toxic]
        assert sum(found) >= 0.9 * len(found) > 10
    assert sum(got[i] for i, _, _, toxic in rows[4000:] if not toxic) <= 10


def test_toxicity_scores_by_hand(spark):
    """Scores of every row, odd ones too, equal the chain's weights applied word by word; other columns do no harm."""
    rows = [(1, "a vile thing"), (1, "a vile thing"), (2, "Vile awful " * 30_000), (3, ""), (4, None), (None, "plain awful"), (5, "plain " * 200_000)]
    unique = lambda k: " ".join(f"w{'abcdefghij'[k // 10]}{'abcdefghij'[(k * 7 + n) % 10]}{n * 'z'}" for n in range(6))
    rows += [(100 + k, ("vile " if k % 3 == 0 else "fine ") + unique(k)) for k in range(90)]
    docs = spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, toxic int, p_toxic string")
    truth = spark.createDataFrame([(100 + k, k % 2, int(k % 3 == 0)) for k in range(90)], "doc_id long, quality int, toxic int")
    ready(spark)
    chain = toxicity.learn_chain(docs, truth, "doc_id", "text", toxicity.categories(), 100)
    want = []
    for i, text in rows:
        held = {toxicity.xxhash.xxh32_intdigest(w) % toxicity.BUCKETS for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
        z = []
        for link in chain:
            z.append(max(-8.0, min(8.0, link.bias + sum(w for b, w in link.weights.items() if b in held) + sum(a * x for a, x in zip(link.earlier, z)))))
        p = [1 / (1 + np.exp(-x)) for x in z]
        want.append((str(i), *p))
    got = sorted((str(r[0]), *r[1:4], r[4]) for r in toxicity.classify(docs, truth, fit_rows=100).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and max(abs(x - y) for x, y in zip(a[1:4], b[1:4])) < 1e-9 for a, b in zip(got, sorted(want)))
    assert all(r[4] == (r[1] >= 0.5) for r in got) and 25 <= sum(r[4] for r in got) <= 45


def packed_tokens(rows):
    """(id, length) of the pieces that brute force cuts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        for start, length in genetic_packing.cut_pieces(n):
            out[i, start, length] += 1
    return out


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on its own input: what it keeps is what its operator says, rows and columns whole."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            good = {r.doc_id for r in quality.weak_label_quality(before).filter("keep").collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == good
        if k == 1:
            assert counts[1] == before.select(exact_text(before)).distinct().count()
        if k == 2:
            want = brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {c for _, c in want.values()}
        if k == 3:
            plan = {r.doc_id: 1 if not r["size"] else int(r.taken / r["size"] + 0.5) for r in curriculum.mix(before).collect()}
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == Counter({i: n for i, n in plan.items() if n})
        if k == 4:
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert Counter((r.doc_id, r.start, r.length) for r in docs.collect()) == packed_tokens(rows)
    assert counts[0] >= counts[1] >= counts[2] and counts[4] >= counts[3]


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Nulls in every column, no words, repeated ids and rows, a very long text, columns with clashing names, no rows."""
    import corpus_pipeline

    prose = "The river runs past the old mill, and people walk along its banks when the evening is warm. They talk of harvests, of letters, of the road north. "
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (1, "Another text of the same id, which nobody has copied, about boats and the men who mend them.", "en", "a", 9), (None, prose.upper().lower(), None, None, None)]
    rows += [(None, "A text without an id, quite unlike the others in what it says and how it says it, stays too.", "en", "b", 1), (2, None, "en", "b", None), (3, "", None, "b", 0), (4, " \n\t ", "en", None, 4), (5, prose * 900, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"root": F.lit(1), "row_key": F.lit("x"), "__row_key": F.lit("y"), "node": F.lit(2.5), "keep": F.lit(True), "size": F.lit(3), "__id": F.lit(4), "position": F.lit("p"), "length": F.lit(7)})
    ready(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "genetic_packing":
            assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    texts = lambda name: Counter((r.doc_id, r.text) for r in kept[name])
    assert not any(not (t or "").strip() for _, t in texts("quality_classifier"))
    first = texts("exact_dedup")
    assert first[1, rows[0][1]] == 1 and first[1, rows[2][1]] == 1 and first[None, rows[4][1]] == 1 and sum(first.values()) == 6
    near = texts("minhash_near_dedup")
    assert near[1, rows[0][1]] == 1 and near[1, rows[2][1]] == 1 and near[None, rows[4][1]] == 1 and near[2, None] == near[3, ""] == near[4, rows[7][1]] == 1
    assert {t for _, t in texts("curriculum_mix")} >= {rows[8][1]}
    assert Counter((r.doc_id, r.start, r.length) for r in kept["genetic_packing"]) == packed_tokens([r[:2] for r in rows])


def exact_text(df):
    from gridloom.llm.common import lower_ascii

    return lower_ascii(F.col("text")).alias("t")


def test_packing_does_not_depend_on_partitions(spark):
    """The same rows in other partitions, repeated ones among them: the same sequences but for their numbers."""
    rng = random.Random(8)
    rows = [(k % 150 if k % 7 else None, " ".join(["word"] * rng.randint(1, 700))) for k in range(300)] + [(9, "same text " * 40)] * 30
    ready(spark)
    seen = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        bins = defaultdict(list)
        for r in genetic_packing.pack(docs, block=32).collect():
            bins[r.sequence_id].append((r.offset, str(r.doc_id), r.piece, r.length, r.ids_crc32))
        seen.append(Counter(tuple(sorted(b)) for b in bins.values()))
        assert all(sum(x[3] for x in b) <= 2048 for b in bins.values())
    assert seen[0] == seen[1]


def test_packing_passes_end(spark):
    """Pieces of which no two fit together end the passes at once; many blocks of small pieces leave few loose ends."""
    items = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("word " * 1200).alias("text"))
    ready(spark)
    got = genetic_packing.pack(items, block=16).collect()
    assert len({r.sequence_id for r in got}) == 400
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(["word"] * rng.randint(1, 300))) for k in range(1500)], "doc_id long, text string")
    got = genetic_packing.pack(docs, block=64).collect()
    assert len({r.sequence_id for r in got}) <= 1.02 * -(-sum(r.length for r in got) // 2048) + 2


def test_crossover_beats_best_fit():
    """Triples that fill a bin exactly: best fit decreasing needs more bins than the genetic steps do after it."""
    rng = random.Random(5)
    size = []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(255, (1000 - a) // 2)
        size += [a, b, 1000 - a - b]
    wins = 0
    for seed in range(6):
        p = genetic_packing.Population(size, 1000, seed)
        members = p.start(8)
        best_fit = len(members[0])
        best = p.evolve(members, 300)[0]
        assert sorted(i for b in best for i in b) == list(range(60)) and min(p.room(best)) >= 0 and len(best) <= best_fit
        wins += len(best) < best_fit
    assert wins >= 3


def test_licences_of_long_and_repeated_texts(spark):
    long = "word " * 200_000 + "Under the MIT License " + "tail " * 50_000
    docs = spark.createDataFrame([(1, long), (2, "cc by nc"), (2, "cc by nc"), (3, "cc-by-nc cc by-nc" * 2)], "doc_id long, text string")
    ready(spark)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.digest(licences.scan(docs)).collect())
    assert got == {(1, 250_004, 1, 200_000, 200_000, "mit"): 1, (2, 3, 1, 0, 0, "cc-by-nc"): 2, (3, 11, 2, 0, 8, "cc-by-nc"): 1}


def test_quality_of_long_texts_ties_and_rare_junk(spark):
    """Equal texts get equal scores; junk of one in three hundred is in the sample and is rejected; very long texts are read whole."""
    rng = random.Random(6)
    words = "the of river house letters evening people walk along north road mill boats mend harvest warm old banks talk quiet".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["BUY", "NOW!!", "$$%%", "|", "||", "##@@", "FREE!!"]) for _ in range(40))
    rows = [(k, junk() if k % 300 == 0 else prose(60)) for k in range(3000)] + [(9000, prose(200_000)), (9001, "A b."), (9002, "A b."), (9003, " \n ")]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, score double, post boolean")
    ready(spark)
    got = {r.doc_id: r for r in quality.weak_label_quality(docs, fit_rows=400).collect()}
    assert sum(got[k].keep for k in range(0, 3000, 300)) <= 1 and sum(got[k].keep for k in range(3000) if k % 300) > 2950
    assert got[9000].keep and got[9001].score == got[9002].score and not got[9003].keep and got[9003].score == 0
    assert quality.keep_good(docs, fit_rows=400).columns == docs.columns


def test_quality_by_hand(spark, sf):
    """Votes of every document, the patterns' counts and the scores, worked out in plain Python on the whole small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ready(spark)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

    def votes(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, size = max(1, len(words)), max(1, len(t))
        share = lambda pattern: len(re.findall(pattern, t)) / n
        capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", t)) / n
        odd = sum(not (c.isalpha() or c in " \t\n\v\f\r.,;:?'-") for c in t) / size
        kinds, each, enough = len(set(re.split(r"[\x20\x09-\x0D]+", t.lower()))) / n, size / n, n >= 8
        first = lambda bad, good: 0 if bad else 1 if good else None
        return (
            0 if share(r"[#$%&*@^~=+<>]{2,}") > 0.15 else None, 0 if t.count("|") / n > 0.15 else None, 0 if t.count("!!") / n > 0.15 else None,
            0 if enough and len(re.findall(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D](?=\1[\x20\x09-\x0D])", t)) / n > 0.15 else None,
            first(enough and capitals > 0.25, enough and capitals < 0.05), first(odd > 0.06, odd < 0.03), first(enough and kinds < min(0.3, 3 / n**0.5), enough and kinds > 0.4), first(each < 2.5 or each > 14, enough and 3.5 < each < 11),
        )

    measured = docs.select("doc_id", *[m.alias(k) for k, m in quality.measures(F.col("text")).items()])
    got = {r[0]: tuple(r[1:]) for r in measured.select("doc_id", *[v.alias(k) for k, v in quality.labellers().items()]).collect()}
    assert got == {i: votes(t) for i, t in texts.items()}
    weights, share = quality.learn_scorer(docs.select(F.col("doc_id").alias("id"), "text"))
    counts = Counter(votes(t) for t in texts.values() if t.strip())
    assert share == pytest.approx(quality.estimate([(p, float(n)) for p, n in counts.items()])[0], abs=1e-9)
    for r in quality.weak_label_quality(docs).collect():
        z = float(np.dot(quality.features(texts[r.doc_id]).astype(float), weights[:-1].astype(float)) + weights[-1])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-4 and r.keep == (r.score >= 0.5)
