"""Language ID: the mixture of languages of each text by expectation-maximisation.

A language's model is the frequency of letter n-grams (four bytes of UTF-8, word borders
included, hashed to ``FEATURES`` numbers) in a sample of labelled documents. A text is taken as
n-grams drawn from a mixture of languages; EM estimates the shares. Then the set of languages is
selected: sets of the 1, 2, ... most frequent ones, each fitted anew, compete by log likelihood less
a penalty for every language beyond the first.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.common import free_name, with_columns_last
from spoor.llm.words import chunks, text_bytes

FEATURES = 1 << 16
GRAM = 4
SMOOTH = 0.05
# About so many labelled documents of each language are read, drawn by hash of the id.
SAMPLE_DOCS = 10_000
# Up to so many languages the model is one dense table; of more, only what was seen is kept.
DENSE_LANGUAGES = 128
# Counts of n-grams that a task holds before it adds equal ones up or passes them on.
HELD_COUNTS = 1 << 21
ROUNDS = 25
PENALTY = 6.0
# A text is kept for its main language if that makes up so much of it.
LEAST_SHARE = 1 / 3
UNKNOWN = "und"

_byte = np.arange(256)
_LETTER = ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90)) | (_byte >= 128)
# Letters in lower case (A-Z only), everything else a blank.
_FOLD = np.where(_LETTER, np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte), 32).astype(np.uint8)
_BLANK = np.array([32], dtype=np.uint8)


class Sparse:
    """A table of chances: one value per column for n-grams it never saw, and what it saw beyond that."""

    def __init__(self, row: np.ndarray, column: np.ndarray, more: np.ndarray, least: np.ndarray, rows: int):
        self.row, self.column, self.more, self.least, self.rows = row, column, more, least, rows
        self.shape = (rows, len(least))

    def __matmul__(self, shares: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.more * shares[self.column], self.rows) + self.least @ shares

    def weigh(self, number: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.more * number[self.row], len(self.least)) + self.least * number.sum()

    def log_sums(self, number: np.ndarray) -> np.ndarray:
        beyond = number[self.row] * np.log1p(self.more / self.least[self.column])
        return np.bincount(self.column, beyond, len(self.least)) + number.sum() * np.log(self.least)

    def of_columns(self, some: np.ndarray) -> Sparse:
        place = np.full(len(self.least), -1)
        place[some] = np.arange(len(some))
        own = place[self.column] >= 0
        return Sparse(self.row[own], place[self.column[own]], self.more[own], self.least[some], self.rows)


@dataclass(frozen=True)
class SparseRows:
    """The chances of all n-grams, by n-gram: those of ``slot`` begin at ``start[slot]``."""

    start: np.ndarray
    column: np.ndarray
    more: np.ndarray
    least: np.ndarray

    def __getitem__(self, slot: np.ndarray) -> Sparse:
        first, many = self.start[slot], self.start[slot + 1] - self.start[slot]
        row = np.repeat(np.arange(len(slot)), many)
        at = np.arange(len(row)) + np.repeat(first - (np.cumsum(many) - many), many)
        return Sparse(row, self.column[at], self.more[at], self.least, len(slot))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    chance: np.ndarray | SparseRows  # (FEATURES, languages)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct n-grams and how often each occurs."""
    data, bounds = text_bytes(texts)
    folded = _FOLD[data]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = np.concatenate([_BLANK, folded[a:b], _BLANK])
        own = own[np.concatenate([[True], (own[1:] != 32) | (own[:-1] != 32)])]  # one blank between words
        if len(own) < GRAM:
            own = np.concatenate([own, np.full(GRAM - len(own), 32, np.uint8)])
        wide = own.astype(np.uint32)
        code = wide[: len(own) - GRAM + 1].copy()
        for k in range(1, GRAM):
            code = (code << np.uint32(8)) | wide[k : len(own) - GRAM + 1 + k]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 16)
        yield np.unique(slot, return_counts=True)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows of (doc_id, text, lang): about ``sample_docs`` rows of each language.

    Rows are drawn by hash of the id, so the sample is the same each time; a null id is drawn like
    any other. Every language is learned; the model's size is that of the n-grams seen in each.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    languages = [name for name, _ in counted]
    if not languages:
        return Model([], np.zeros((FEATURES, 0)))
    known = [(name, i, min(1.0, sample_docs / n)) for i, (name, n) in enumerate(counted)]
    known = labelled.sparkSession.createDataFrame(known, "lang string, _rank int, _share double")
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # One row per language, and the driver holds all.
    drawn = labelled.select("lang", "text", draw.alias("_draw")).join(F.broadcast(known), "lang")
    sample = drawn.filter(F.col("_draw") < F.col("_share")).select("_rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for rank, (slot, number) in zip(batch.column(0).to_pylist(), features(batch.column(1))):
                held.append((slot.astype(np.int64) + rank * FEATURES, number))
                size += len(slot)
                if size >= HELD_COUNTS:
                    held = [_add_up(held)]
                    size = len(held[0][0])
                    if size >= HELD_COUNTS // 2:
                        yield _counts(*held[0])
                        held, size = [], 0
        if held:
            yield _counts(*_add_up(held))

    counts = sample.mapInArrow(run, "lang int, slot int, number bigint").groupBy("lang", "slot").agg(F.sum("number").alias("n"))
    # One row per language and n-gram seen in it.
    table = counts.toArrow()
    lang, slot, n = (table[c].to_numpy() for c in ("lang", "slot", "n"))
    total = np.bincount(lang, n, len(languages)) + SMOOTH * FEATURES
    if len(languages) <= DENSE_LANGUAGES:
        number = np.full((FEATURES, len(languages)), SMOOTH)
        number[slot, lang] += n
        return Model(languages, number / total)
    order = np.lexsort((lang, slot))
    lang, slot, n = lang[order], slot[order], n[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=FEATURES))])
    return Model(languages, SparseRows(start, lang.astype(np.int32), n / total[lang], SMOOTH / total))


def _add_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)


def _counts(key: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    lang, slot = (key // FEATURES).astype(np.int32), (key % FEATURES).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(number)], names=["lang", "slot", "number"])


def _weigh(chance: np.ndarray | Sparse, number: np.ndarray) -> np.ndarray:
    return chance.weigh(number) if isinstance(chance, Sparse) else chance.T @ number


def _fit(chance: np.ndarray | Sparse, number: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns) and the log likelihood."""
    total, k = number.sum(), chance.shape[1]
    shares = np.full(k, 1.0 / k)
    for _ in range(rounds if k > 1 else 0):
        mixed = chance @ shares
        shares_new = shares * _weigh(chance, number / mixed) / total
        done = np.abs(shares_new - shares).max() < 1e-4
        shares = shares_new
        if done:
            break
    return shares, float(number @ np.log(chance @ shares))


def mixture(model: Model, slot: np.ndarray, number: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """Selected languages, most frequent first, and the shares of all when all are allowed.

    n-grams overlap, each letter being in GRAM of them, so the likelihood is divided by GRAM.
    """
    chance = model.chance[slot]
    shares, likelihood = _fit(chance, number)
    sparse = isinstance(chance, Sparse)
    single = chance.log_sums(number) if sparse else number @ np.log(chance)
    best = int(np.argmax(single))
    chosen, top = [best], single[best] / GRAM
    # No set of languages does better than all together.
    if likelihood / GRAM - penalty > top:
        ranked = np.argsort(-shares, kind="stable")
        for k in range(2, len(model.languages) + 1):
            if likelihood / GRAM - penalty * (k - 1) <= top:
                break
            some = ranked[:k]
            own, fit = _fit(chance.of_columns(some) if sparse else chance[:, some], number)
            if fit / GRAM - penalty * (k - 1) > top:
                top = fit / GRAM - penalty * (k - 1)
                chosen = [int(x) for x in some[np.argsort(-own, kind="stable")]]
    return chosen, shares


def _has_letter(text: str) -> Column:
    """A letter is what Unicode calls one; the bytes alone cannot tell."""
    return F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))


def identify(
    docs: DataFrame, model: Model, text: str = "text", outputs=("lang_pred", "score", "langs"), keep_text: bool = True
) -> DataFrame:
    """Add the main language, its share (0 to 1) and all selected languages, the main one first.

    Null texts and texts without a letter are ``und`` with score 0 and no languages, as is every
    text when no language was learned. Columns of the input with an output's name give way.
    ``keep_text=False`` leaves the text out, so that it is not sent back from Python.
    """
    name, score, langs = outputs
    unknown = {name: UNKNOWN, score: 0.0, langs: []}
    letter = free_name([*docs.columns, *outputs], "_letter")
    has_letter = _has_letter(text) & F.lit(bool(model.languages))
    none = {name: F.lit(UNKNOWN), score: F.lit(0.0), langs: F.array().cast("array<string>"), letter: has_letter}
    asked = with_columns_last(docs, none)
    kept = [f for f in asked.schema.fields if f.name != letter and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                names = part.schema.names
                found = []
                for known, (slot, number) in zip(
                    part.column(names.index(letter)).to_pylist(), features(part.column(names.index(text)))
                ):
                    if known:
                        chosen, shares = mixture(model, slot, number)
                        own = [model.languages[i] for i in chosen]
                        found.append((own[0], float(shares[chosen[0]]), own))
                    else:
                        found.append(tuple(unknown.values()))
                new = {c: pa.array([f[i] for f in found], type=part.schema.field(c).type) for i, c in enumerate(outputs)}
                yield pa.RecordBatch.from_arrays(
                    [new[f.name] if f.name in new else part.column(names.index(f.name)) for f in kept],
                    names=[f.name for f in kept],
                )

    return asked.mapInArrow(run, T.StructType(kept))


def keep_identified(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    languages: Collection[str] | None = None,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """The documents whose main language is one of ``languages`` (all learned ones when None) and
    makes up ``least_share`` of the text or more, with their own columns.

    Null texts and texts without a letter go. When no language was learned, nothing can be told of
    the others, and every document with a letter stays. Texts are sent to Python and only the
    prediction comes back.
    """
    if not model.languages:
        return docs.filter(_has_letter(text))
    wanted = None if languages is None else set(languages)
    accepted = [name for name in model.languages if wanted is None or name in wanted]

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    def main_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, main = [], []
            for some in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
                for slot, number in features(some.column(0)):
                    chosen, shares = mixture(model, slot, number)
                    names.append(model.languages[chosen[0]])
                    main.append(float(shares[chosen[0]]))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(main, pa.float64())], names=["lang", "share"])
            del texts
            pa.default_memory_pool().release_unused()

    found = main_language(F.col(f"`{text}`"))
    lettered = docs.filter(_has_letter(text))
    return lettered.filter(found["lang"].isin(accepted) & (found["share"] >= least_share))
