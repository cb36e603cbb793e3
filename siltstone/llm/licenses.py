"""Operator 13: license scans by diagonal voting.

A template is a phrase or the words of a license notice. All rolling hashes of
``GRAM`` words (of a shorter phrase: all its words) of every text are joined by
Spark to the template positions with the same hash. A pair votes for a
diagonal, its place in the text less its place in the template; votes are added
up by text, template and diagonal, partly before the shuffle. Diagonals so near
that words put in or left out may lie between them are merged. A merged
diagonal with as many votes as a span of ``SHARE`` of the template's words must
have, by the lemma on shared grams, is verified on the words themselves: a
phrase word by word, a notice by the longest common subsequence.

Phrases are exact and their diagonals never merged, so each place is one span;
notices that touch or overlap may be one span.

The words of all texts are written once; hashes are not. Verification joins
only the words of texts that have candidates.

Defined cases: a null text is empty and has no words; an empty text has no
spans and score 0; rows repeated are scanned each for itself; doc_id may be
null, repeated or of any type; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import documents, map_arrow, materialise, slices, text_of

#: Words in a hash, and the share of a notice's words, in order, that a span must have.
GRAM, SHARE = 3, 0.8
#: Words put in or left out that the merged diagonals of a notice may differ by, as a part of its words.
BAND = 8
#: Template positions up to so many, some 3 MB, are broadcast; beyond, they are joined by shuffle.
BROADCAST_GRAMS = 100_000
#: Numbers of texts with candidates up to so many, some 16 MB, are broadcast, so that only their words are shuffled; beyond, all words are.
BROADCAST_ROWS = 1_000_000
#: A worker remembers the hashes of so many words, then begins anew.
MEMORY = 500_000
STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that separate words become spaces and A-Z lower case; bytes from 0x80 on, of letters beyond ASCII, stay.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: A-Z lower-cased, ASCII other than letters and digits between them."""
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    """A label and its words; an exact phrase counts at every place, a notice where ``SHARE`` of its words stand in order."""

    label: str
    text: str
    exact: bool = False
    base: bool = False

    @property
    def words(self) -> tuple[bytes, ...]:
        return tuple(words_of(self.text.encode()))

    @property
    def gram(self) -> int:
        return min(GRAM, len(self.words))

    @property
    def band(self) -> int:
        return 0 if self.exact else len(self.words) // BAND

    @property
    def votes(self) -> int:
        """What a good span has at least: each of the words that may differ spoils at most ``gram`` grams."""
        n = len(self.words)
        spoiled = 0 if self.exact else self.gram * int((1 - SHARE) * n + 1e-9)
        return max(1, n - self.gram + 1 - spoiled)


# The phrases of the contract, and sentences of the public licenses' own texts and notices.
TEMPLATES = (
    Template("mit", "mit license", exact=True, base=True),
    Template("apache", "apache license", exact=True, base=True),
    Template("gpl", "general public license", exact=True, base=True),
    Template("reserved", "all rights reserved", exact=True),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def gram_hashes(words: list[bytes], k: int, hashes: dict) -> np.ndarray:
    """Rolling hashes of ``k`` words, as signed 64-bit numbers; the number of words is in the hash."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            found = found * STEP + one[i : i + n]
    return found.view(np.int64)


def text_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_words, words): the words of every text, joined by spaces; ``row`` tells the rows apart. Written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in slices(batches, 1):
            found = [words_of(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
            rows = pa.array(np.arange(at, at + len(found)))
            at += len(found)
            yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array([b" ".join(w) for w in found], pa.binary())], names=["row", key, "n_words", "words"])

    kind = docs.schema[key].dataType.simpleString()
    return materialise(map_arrow(docs.select(key, text_of(text).alias("text")), cut, f"row long, `{key}` {kind}, n_words long, words binary"), "license-words", "zstd")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(gram, template, place): the hash at every place of every template."""
    hashes = _Hashes()
    rows = [(int(g), t, place) for t, x in enumerate(templates) for place, g in enumerate(gram_hashes(list(x.words), x.gram, hashes).tolist())]
    found = spark.createDataFrame(rows, "gram long, template int, place long")
    return F.broadcast(found) if len(rows) <= BROADCAST_GRAMS else found


def votes(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, template, diagonal, votes, start, end): all rolling hashes of all texts joined to the template positions."""
    sizes = sorted({t.gram for t in templates})

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in slices(batches, 1, 2 << 20):
            texts = [t.split() for t in part.column(1).to_pylist()]
            for k in sizes:
                found = [gram_hashes(t, k, hashes) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(texts), k, np.int32)), lists], names=["row", "k", "grams"])

    rolled = map_arrow(words.select("row", "words"), roll, "row long, k int, grams array<long>")
    pairs = rolled.select("row", "k", F.posexplode("grams").alias("at", "gram")).join(template_grams(words.sparkSession, templates), "gram")
    diagonal = (F.col("at") - F.col("place")).alias("diagonal")
    return pairs.groupBy("row", "template", diagonal).agg(F.count("*").alias("votes"), F.min("at").cast("long").alias("start"), F.max(F.col("at") + F.col("k")).cast("long").alias("end"))


def candidates(voted: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, template, diagonal, start, end) of merged diagonals with enough votes; the diagonal is that with the most."""
    about = voted.sparkSession.createDataFrame([(t, x.band, x.votes) for t, x in enumerate(templates)], "template int, band int, least int")
    rows = voted.join(F.broadcast(about), "template")
    w = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.col("band"), F.lit(True))
    islands = rows.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(w))
    merged = islands.groupBy("row", "template", "island", "least").agg(F.sum("votes").alias("votes"), F.max(F.struct("votes", -F.col("diagonal"))).alias("peak"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.where("votes >= least").select("row", "template", (-F.col("peak.col2")).alias("diagonal"), "start", "end")


def common(template: tuple[bytes, ...], words: list[bytes]) -> int:
    """The length of the longest common subsequence, by bits of one number."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    free = full
    for w in words:
        met = free & places.get(w, 0)
        free = ((free + met) | (free - met)) & full
    return len(template) - free.bit_count()


def scan(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, spans): verified spans (template, label, base, start, end, share) of texts that have any; words from 0, end exclusive."""
    found = candidates(votes(words, templates), templates).groupBy("row").agg(F.collect_list(F.struct("template", "diagonal", "start", "end")).alias("found"))
    found = materialise(found, "license-candidates")  # a row's are no more than its words
    texts, asked = words.select("row", "words"), found.select("row")
    if found.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(asked), "row", "left_semi")
    held = texts.join(found, "row")
    struct = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            out = []
            for text, asked in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                own, spans = text.split(), []
                for c in asked:
                    t = templates[c["template"]]
                    size, first = len(t.words), c["diagonal"]
                    if t.exact:
                        good, start, end = float(tuple(own[first : first + size]) == t.words), first, first + size
                    else:
                        start, end = max(c["start"], first - t.band, 0), min(c["end"], first + size + t.band)
                        good = common(t.words, own[max(0, first - t.band) : first + size + t.band]) / size
                    if good >= (1 if t.exact else SHARE):
                        spans.append({"template": c["template"], "label": t.label, "base": t.base, "start": start, "end": end, "share": good})
                out.append(sorted(spans, key=lambda s: (s["start"], s["template"])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, struct)], names=["row", "spans"])

    return map_arrow(held.select("row", "words", "found"), verify, "row long, spans array<struct<template:int,label:string,base:boolean,start:bigint,end:bigint,share:double>>")


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, spans) of every document."""
    words = text_words(docs, key, text)
    found = materialise(scan(words, templates), "license-spans")
    return words.select("row", key, "n_words").join(found, "row", "left").drop("row")


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    found = license_scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    places = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ","), F.lit(""))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("spans"),
    )
