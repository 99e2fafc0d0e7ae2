"""Licence scan by a positional index of rare words.

A template is a sequence of words with a label; its key phrases (runs of its words) are mandatory.

1. One pass counts, over all documents, how many hold each word of the templates; that gives the words' IDF. What
   reaches the driver is a row for each template word.
2. A file's template words are looked up highest IDF first. A word's posting lists the templates and places where it
   stands; an occurrence at file position p of a word at template place o says that the template starts at p - o.
   The starts of a template's rarest words are intersected: words that are not at the same relative position drop
   out. For a key phrase all its words must agree, so no place of a key phrase can be missed.
3. A start stands if every key phrase of the template is verified word by word at its place and the words found carry
   at least ``MATCH`` of the template's IDF.

Words are maximal runs of ASCII digits and letters and of any characters beyond ASCII, A-Z lower-cased.

Edge cases: a null text is an empty one: 0 words, no labels, score 0; a null id and repeated rows are reported as they
come; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MATCH = 0.7
#: Rarest words of a template that are looked up to find its starts.
RAREST = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # [start, end) of the mandatory phrases

    @staticmethod
    def of(label: str, text: str, *keys: str) -> Template:
        """``keys`` are phrases of ``text``; without any, the whole text is one."""
        words = tuple(text.split())
        spans = []
        for phrase in keys or (text,):
            part = tuple(phrase.split())
            at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
            spans.append((at, at + len(part)))
        return Template(label, words, tuple(spans))


# Licence wording.
BASE = (
    Template.of("mit", "under the mit license"),
    Template.of("apache-2", "apache license version 2"),
    Template.of("cc-by-nc", "cc by nc"),
)
MORE = (
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template.of("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    Template.of("gpl-3", "gnu general public license version 3"),
    Template.of("gpl-2", "gnu general public license version 2"),
    Template.of("lgpl", "gnu lesser general public license"),
    Template.of("agpl-3", "gnu affero general public license"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template.of("mpl-2", "mozilla public license version 2"),
    Template.of("cc-by-sa", "cc by sa"),
    Template.of("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain"),
)

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Words:
    """A text's word starts and ends in bytes, found without making the words."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() touches A-Z only
        inside = np.zeros(len(self.raw) + 2, dtype=np.int8)
        inside[1:-1] = _WORD[np.frombuffer(self.raw, dtype=np.uint8)]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> bytes:
        return self.raw[self.starts[k] : self.ends[k]]

    def positions(self, word: bytes) -> list[int]:
        """Word numbers at which ``word`` stands whole."""
        out, at, n = [], self.raw.find(word), len(word)
        while at >= 0:
            k = int(np.searchsorted(self.starts, at))
            if k < len(self.starts) and self.starts[k] == at and self.ends[k] == at + n:
                out.append(k)
            at = self.raw.find(word, at + 1)
        return out


class Index:
    """Postings of the templates' words, with the words' IDF."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]):
        self.templates = templates
        self.idf = {w.encode(): idf.get(w, 0.0) for t in templates for w in t.words}
        self.rank = sorted(self.idf, key=lambda w: (-self.idf[w], w))
        self.words = [[w.encode() for w in t.words] for t in templates]
        self.total = [sum(self.idf[w] for w in t) for t in self.words]
        # Of each template, places of the rarest words of its first key phrase.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need: list[int] = []
        for k, t in enumerate(templates):
            a, b = t.keys[0]
            rare = sorted(range(a, b), key=lambda o: (-self.idf[self.words[k][o]], o))[:RAREST]
            self.need.append(len(rare))
            for o in rare:
                self.postings[self.words[k][o]].append((k, o))
        self.looked_up = [w for w in self.rank if w in self.postings]

    def find(self, file: Words) -> list[tuple[int, int, int, float]]:
        """(template, first word, one past the last, score) of each verified place, in order of place."""
        votes: Counter = Counter()
        dead: set[int] = set()
        for word in self.looked_up:
            wanted = [(k, o) for k, o in self.postings[word] if k not in dead]
            if not wanted:
                continue
            at = file.positions(word) if word in file.raw else []
            if not at:
                dead.update(k for k, _ in wanted)
                continue
            for k, o in wanted:
                votes.update((k, p - o) for p in at)
        out = []
        for (k, start), n in votes.items():
            if k in dead or n < self.need[k]:
                continue
            t, words = self.templates[k], self.words[k]
            if any(start + a < 0 or start + b > len(file) or any(file[start + o] != words[o] for o in range(a, b)) for a, b in t.keys):
                continue
            here = [0 <= start + o < len(file) and file[start + o] == w for o, w in enumerate(words)]
            total = self.total[k]
            score = 1.0 if all(here) or not total else sum(self.idf[w] for w, ok in zip(words, here) if ok) / total
            if score >= MATCH:
                first, last = here.index(True), len(here) - here[::-1].index(True)
                out.append((k, start + first, start + last, min(1.0, score)))
        return sorted(out, key=lambda x: (x[1], x[0]))


#: Bytes to lower case, and to a space where no word can hold them.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))


def _frequency(vocabulary: list[str]):
    wanted = {w.encode() for w in vocabulary}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, Counter()
        for batch in batches:
            for text in batch["text"]:
                n += 1
                found.update(wanted.intersection((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()))
        yield pd.DataFrame({"word": ["", *(w.decode() for w in found)], "n": [n, *found.values()]})

    return run


def _scan(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                file = Words(text)
                hits = [{"label": index.templates[k].label, "base": k < len(BASE), "first": a, "end": b, "score": s} for k, a, b, s in index.find(file)]
                rows.append((doc, len(file), hits))
            yield pd.DataFrame(rows, columns=["id", "n_words", "hits"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + MORE) -> DataFrame:
    """``id_col``, n_words and hits: array of (label, base, first word, end word, score). BASE must lead ``templates``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = sorted({w for t in templates for w in t.words})
    counted = cut(rows.select("text").mapInPandas(_frequency(vocabulary), "word string, n long"))
    df = {r[0]: r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}  # a row for each template word
    n = df.pop("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, hits array<struct<label string, base boolean, first long, end long, score double>>"
    return rows.mapInPandas(_scan(Index(templates, idf)), schema).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each file: counts and places of the base phrases, the base labels, all labels, the best score."""
    base = F.filter("hits", lambda h: h.base)
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    firsts = F.transform(base, lambda h: h["first"])
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h.score)), F.lit(0.0)), 9).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = BASE + MORE) -> str:
    """The digest of a scan in SQL: words that agree at one relative position, all of a template's key phrases among them."""
    rows = [f"({k}, {o}, '{w}', {str(any(a <= o < b for a, b in t.keys)).lower()})" for k, t in enumerate(templates) for o, w in enumerate(t.words)]
    labels = [f"({k}, '{t.label}', {str(k < len(BASE)).lower()}, {sum(b - a for a, b in t.keys)}, {len(t.words)})" for k, t in enumerate(templates)]
    return rf"""
WITH t(k, o, word, mandatory) AS (VALUES {", ".join(rows)}), m(k, label, base, keys, n) AS (VALUES {", ".join(labels)}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), f AS (
  SELECT word, count(DISTINCT doc_id) AS df FROM p WHERE word IN (SELECT word FROM t) GROUP BY word
), x AS (
  SELECT t.*, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1e-6 AS idf FROM t LEFT JOIN f USING (word)
), total AS (
  SELECT k, sum(idf) AS total FROM x GROUP BY k
), h AS (
  SELECT doc_id, k, i - o AS start, min(i) AS first, count(*) AS n, count(*) FILTER (mandatory) AS keys, sum(idf) AS idf FROM p JOIN x USING (word) GROUP BY ALL
), hit AS (
  SELECT h.doc_id, m.label, m.base, h.first, CASE WHEN h.n = m.n THEN 1.0 ELSE h.idf / total END AS score
  FROM h JOIN m USING (k) JOIN total USING (k) WHERE h.keys = m.keys AND (h.n = m.n OR h.idf / total >= {MATCH})
)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (base)::BIGINT AS n_base, min(first) FILTER (base)::BIGINT AS first_word, max(first) FILTER (base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(score), 0), 9)::DOUBLE AS score
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id
"""
