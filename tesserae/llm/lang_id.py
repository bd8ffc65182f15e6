"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its
letters' vectors, each rotated by its distance from the n-gram's end, a text the
sum of its n-grams' vectors, and a language the sum of its texts' vectors. A text
gets the language whose prototype has the largest cosine with it, after the mean
of all prototypes, which is what languages have in common, was taken off both.

Letters' vectors follow from the code point alone, so any worker makes the same
ones. Sums are exact whole numbers, so prototypes don't depend on the order or on lost tasks. N-grams get their vectors
``GRAMS_AT_ONCE`` at a time, so memory doesn't grow with the n-grams of a text.

Defined results: a text that is null or has no letter gets ``und`` with score 0;
ties go to the language that sorts first; with nothing to learn from, every text
gets ``und``; repeated rows get equal rows; an empty table gives an empty result; other columns
of the input play no part, and of those kept, lang_pred and score are replaced by the results. With more than ``MAX_LANGUAGES`` labels
learning fails rather than leave some out, as the driver holds a vector for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, release_memory, small_batches
from .shingles import mix
from .tokens import pieces_of_batch

UNKNOWN = "und"
DIMENSIONS = 1024
GRAM = 3
ROWS_AT_ONCE = 128
GRAMS_AT_ONCE = 4096
MAX_LANGUAGES = 4000


@lru_cache(1 << 14)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1 and -1 of a code point: bits of a scrambled counter."""
    counter = np.arange(dimensions // 64, dtype=np.uint64) + np.uint64(code * dimensions)
    bits = np.unpackbits(mix(mix(counter) + np.uint64(0x9E3779B97F4A7C15)).view(np.uint8))
    return (bits.astype(np.int8) << 1) - 1


@lru_cache(1 << 16)
def _letter(code: int) -> int:
    """The code of a letter as counted; 32 (a blank) for all else."""
    c = chr(code)
    low = c.lower()
    return ord(low[0]) if c.isalpha() else 32


def letters_of(text: str) -> np.ndarray:
    """Lower-cased letters with single blanks between words and around them; empty without a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, where = _distinct(raw)
    codes = np.fromiter(map(_letter, seen.tolist()), np.uint32, len(seen))[where]
    blank = codes == 32
    if blank.all():
        return codes[:0]
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))]
    edge = np.full(1, 32, np.uint32)
    return np.concatenate([edge, codes, edge] if codes[-1] != 32 else [edge, codes])


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and each one's place among them, by counting where codes are small."""
    top = int(codes.max(initial=0)) + 1
    if top > 1 << 17:
        return np.unique(codes, return_inverse=True)
    present = np.zeros(top, bool)
    present[codes] = True
    return np.flatnonzero(present), (np.cumsum(present) - 1)[codes]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' n-grams: (text, number of the n-gram, count), and the letters of each numbered n-gram."""
    parts = [letters_of(t) if t else np.zeros(0, np.uint32) for t in texts]
    sizes = np.array([max(0, len(p) - GRAM + 1) for p in parts], np.int64)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, GRAM), np.int64)
    alphabet, codes = _distinct(np.concatenate(parts))
    lengths = np.array([len(p) for p in parts], np.int64)
    text = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (np.cumsum(lengths) - lengths)[text]
    base, gram = len(alphabet), np.zeros(len(text), np.int64)
    for k in range(GRAM):
        gram = gram * base + codes[at + k]
    if base**GRAM * len(texts) <= 1 << 25:  # count in a table
        table = np.bincount(text * base**GRAM + gram, minlength=0)
        cell = np.flatnonzero(table)
        counts = table[cell]
        text, gram = cell // base**GRAM, cell % base**GRAM
        grams, number = _distinct(gram) if base**GRAM <= 1 << 17 else np.unique(gram, return_inverse=True)
    else:
        grams, number = np.unique(gram, return_inverse=True)
        cell, counts = np.unique(text * len(grams) + number, return_counts=True)
        text, number = cell // len(grams), cell % len(grams)
    digits = np.stack([grams // base ** (GRAM - 1 - k) % base for k in range(GRAM)], axis=1)
    return text, number, counts, alphabet.astype(np.int64)[digits]


def gram_vectors(letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row of +1 and -1 for each n-gram: letters' vectors, permuted by place and bound by multiplication."""
    alphabet, where = np.unique(letters, return_inverse=True)
    where = where.reshape(letters.shape)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in alphabet]) if len(alphabet) else np.zeros((0, dimensions), np.int8)
    out = np.ones((len(letters), dimensions), np.int8)
    for k in range(letters.shape[1]):
        out *= np.roll(vectors, letters.shape[1] - 1 - k, axis=1)[where[:, k]]
    return out


def bundled(owner: np.ndarray, number: np.ndarray, counts: np.ndarray, letters: np.ndarray, owners: int, dimensions: int) -> np.ndarray:
    """For each owner the sum of its n-grams' vectors, as often as they count: exact, in blocks of n-grams."""
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64
    out = np.zeros((owners, dimensions), kind)
    order = np.argsort(number, kind="stable")
    owner, number, counts = owner[order], number[order], counts[order]
    for first in range(0, len(letters), GRAMS_AT_ONCE):
        block = letters[first : first + GRAMS_AT_ONCE]
        own = slice(*np.searchsorted(number, (first, first + len(block))))
        weights = np.bincount(owner[own] * len(block) + number[own] - first, counts[own], owners * len(block)).astype(kind)
        out += weights.reshape(owners, len(block)) @ gram_vectors(block, dimensions).astype(kind)
    return out


def _by_rows(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for part in pieces_of_batch(batch.assign(text=batch["text"].fillna("")), chars=500_000):
        for k in range(0, len(part), ROWS_AT_ONCE):
            yield part.iloc[k : k + ROWS_AT_ONCE]


def learn_prototypes(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundled prototypes, from all rows with a text and a label.

    Each task sums what it reads, so a language moves as one vector per task; the driver
    gets one vector per language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _by_rows(batch):
                text, number, counts, letters = gram_counts(list(part["text"]))
                langs, which = np.unique(part["lang"].to_numpy(str), return_inverse=True)
                vectors = bundled(which[text], number, counts, letters, len(langs), dimensions)
                for lang, vector in zip(langs.tolist(), vectors, strict=True):
                    sums[lang] = sums.get(lang, 0) + np.rint(vector).astype(np.int64)
        release_memory()
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    vectors = rows.mapInPandas(bundle, "lang string, vector array<long>")
    total = vectors.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("v")).orderBy("lang").collect()
    return [r["lang"] for r in found], np.array([r["v"] for r in found], np.float64).reshape(-1, dimensions)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row (its id unless given), lang_pred and score: the cosine with the best prototype, at least 0."""
    small_batches(docs.sparkSession)
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("lang_pred", "score")]
    inner = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)))
    text = inner[keep.index(text_col)] if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else "text"
    if text == "text":
        rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("text"))
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    common = unit.mean(axis=0) if len(unit) > 1 else np.zeros(prototypes.shape[1])
    apart = unit - common
    apart = (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared = (common / max(np.linalg.norm(common), 1e-12)).astype(np.float32)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_rows(pd.DataFrame({"text": batch[text]})):
                yield pd.DataFrame(columns_of(batch, inner, part.index) | _tell(list(part["text"]), languages, apart, shared))
        release_memory()

    fields = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in inner)
    told = rows.mapInPandas(tell, f"{fields}lang_pred string, score double")
    return told.select(*(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)), "lang_pred", "score")


def _tell(texts: list[str], languages: list[str], apart: np.ndarray, shared: np.ndarray) -> dict[str, object]:
    text, number, counts, letters = gram_counts(texts)
    vectors = bundled(text, number, counts, letters, len(texts), apart.shape[1])
    vectors -= (vectors @ shared)[:, None] * shared[None, :]
    size = np.linalg.norm(vectors, axis=1)
    cosines = (vectors @ apart.T) / np.maximum(size, 1e-12)[:, None]
    known = (np.bincount(text, minlength=len(texts)) > 0) & (len(languages) > 0)
    best = cosines.argmax(axis=1) if len(languages) else np.zeros(len(texts), int)
    score = np.clip(cosines.max(axis=1, initial=-1), 0, 1)
    return {"lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], "score": np.where(known, score, 0).astype(float)}


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves no remainder by 5; a null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_hyperdimensional_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_prototypes(docs.where(~held_out()))
    return predict(docs, *model).withColumn("held_out", held_out())


QUERIES = {"op2_hyperdimensional_lang": op2_hyperdimensional_lang}
ORACLES: dict[str, str] = {}
