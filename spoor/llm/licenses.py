"""License scans by a positional index of rare words.

A template is a run of licence words with a mandatory key phrase in it. Word frequencies over all
documents give each licence word its IDF. The index holds, for every template, the positions of
its rarest mandatory words: the first is looked up in the files, and gives a place of the template
in the file; the postings of the others must agree with that place (the same position relative to
it). What is left is verified: the whole key phrase, byte by byte, and the share of the template's
other words that stand where they should.

A template with its key phrase in the file has its rarest mandatory word there, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import with_columns_last
from spoor.llm.words import Words, chunks, words_of

LEAST_SHARE = 0.4
POSTINGS = 3
MATCHES = "array<struct<label:string,base:boolean,start:bigint,words:bigint,share:double>>"


@dataclass(frozen=True)
class Template:
    """``text``'s words; ``key`` is the run of them that must stand in the file."""

    label: str
    text: str
    key: str
    base: bool = False


# Phrases that count by themselves.
BASE = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
]
# Sentences by which files say what licence they are under, and openings of licence texts.
TEMPLATES = BASE + [
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software",
    ),
]


@dataclass(frozen=True)
class Entry:
    """A template as words, with its key phrase and the index postings in it."""

    template: Template
    hashes: np.ndarray
    spelled: list[bytes]
    key: range
    postings: list[int]  # positions of the rarest mandatory words, the rarest first


def _word_list(text: str) -> tuple[np.ndarray, list[bytes]]:
    words = words_of(pa.array([text]))
    return words.hash, [words.bytes_of(i) for i in range(len(words.hash))]


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w.decode() for t in templates for w in _word_list(t.text)[1]})


def document_frequencies(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, int]:
    """In how many of all documents each licence word stands; one number per word and task is summed."""
    known = vocabulary(templates)
    hashes = np.array([_word_list(w)[0][0] for w in known], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hashes)
        ranked = hashes[order]
        sums = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, text):
                words = words_of(part.column(0))
                at = np.minimum(np.searchsorted(ranked, words.hash), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == words.hash)
                pairs = np.unique(words.owner[hit] * len(known) + order[at[hit]])
                sums += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(sums)], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def build_index(templates: Sequence[Template], frequency: dict[str, int]) -> list[Entry]:
    """The rarer a word (the higher its IDF), the earlier its posting is used."""
    index = []
    for template in templates:
        hashes, spelled = _word_list(template.text)
        _, key = _word_list(template.key)
        start = next(i for i in range(len(spelled) - len(key) + 1) if spelled[i : i + len(key)] == key)
        mandatory = range(start, start + len(key))
        rare = sorted(mandatory, key=lambda i: (frequency.get(spelled[i].decode(), 0), i))
        index.append(Entry(template, hashes, spelled, mandatory, rare[:POSTINGS]))
    return index


def _matches(words: Words, index: list[Entry], least: float) -> list[tuple[int, Entry, int, float]]:
    """Text, entry, first word of the key phrase in the text, and share of the template's words."""
    looked_up = np.array(sorted({int(e.hashes[e.postings[0]]) for e in index}), dtype=np.uint64)
    slot = np.minimum(np.searchsorted(looked_up, words.hash), len(looked_up) - 1)
    seen = np.flatnonzero(looked_up[slot] == words.hash)
    found = []
    for entry in index:
        key = entry.key
        anchor = entry.postings[0]
        at = seen[words.hash[seen] == entry.hashes[anchor]]
        text = np.searchsorted(words.first, at, side="right") - 1
        place = at - anchor  # of the template's first word; it may lie before the text
        low, high = words.first[text], words.first[text + 1]
        fits = (place + key.start >= low) & (place + key.stop <= high)
        place, text, low, high = place[fits], text[fits], low[fits], high[fits]
        for j in [*entry.postings[1:], *key]:
            same = words.hash[place + j] == entry.hashes[j]
            place, text, low, high = place[same], text[same], low[same], high[same]
        share = np.zeros(len(place))
        for j in range(len(entry.hashes)):
            inside = np.flatnonzero((place + j >= low) & (place + j < high))
            share[inside] += words.hash[place[inside] + j] == entry.hashes[j]
        share /= len(entry.hashes)
        for p, t, s in zip(place.tolist(), text.tolist(), share.tolist()):
            if s >= least and all(words.bytes_of(p + j) == entry.spelled[j] for j in key):
                found.append((t, entry, p + key.start - int(words.first[t]), s))
    return found


def scan(
    docs: DataFrame, templates: Sequence[Template] = tuple(TEMPLATES), text: str = "text", least: float = LEAST_SHARE,
    outputs: tuple[str, str] = ("n_words", "matches"),
) -> DataFrame:
    """Add the number of words, and the licence matches of each text in order of place.

    A match has the template's label, whether it is a base phrase, the first word of the key phrase
    in the text (from 0), the words of the phrase, and the share of the template's words found at
    their places, which is ``least`` or more. Null texts have no words. Rows stay as they are;
    columns with an output's name give way. Reads the documents twice: for the IDF, and to scan.
    """
    index = build_index(templates, document_frequencies(docs, templates, text))
    n_words, matches = outputs
    out = with_columns_last(docs, {n_words: F.lit(0).cast("long"), matches: F.array().cast(MATCHES)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                names = part.schema.names
                words = words_of(part.column(names.index(text)))
                lists: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for t, entry, start, share in _matches(words, index, least):
                    template = entry.template
                    lists[t].append(
                        {"label": template.label, "base": template.base, "start": start, "words": len(entry.key), "share": share}
                    )
                for own in lists:
                    own.sort(key=lambda m: (m["start"], m["label"]))
                new = {
                    n_words: pa.array(words.counts.astype(np.int64)),
                    matches: pa.array(lists, type=part.schema.field(matches).type),
                }
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names=names)

    return out.mapInArrow(run, out.schema)
