"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram binds the vectors of its letters,
each permuted by its place, by multiplication; a text bundles its trigrams by addition, and
a language prototype bundles its texts.  A document has the language whose prototype has
the highest cosine with it.  Vectors come from seeded hashes, so every task makes the same.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from edgeframe.llm.common import free_name, small_batches

DIM = 1024
NONE = "und"
UNIT = 1e6              # weight of a text in a prototype; sums are of whole numbers
SHIFT = 21              # bits of a letter in the code of a trigram
SLICE = 4_096           # trigram vectors held at a time, 20 MB
CHARS = 500_000         # characters taken apart at a time
NOISE = 3 / DIM ** 0.5  # cosine that texts without a common trigram seldom reach
SURE = 200              # characters of a text that can be told from noise


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)),
                       bool, sys.maxunicode + 1)


@functools.lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    bits = np.random.default_rng([20, code]).integers(0, 2, DIM, dtype=np.int8)
    return 2 * bits - 1


def _codes(text: str) -> np.ndarray:
    """Code points of letters, 0 for anything else."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(letter_table()[codes], codes, 0).astype(np.int64)


def trigrams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, trigram code) of all trigrams of all texts, in pairs of arrays of
    bounded length.  Letters are lower-cased; a run of anything else is one blank; a blank
    stands at either end."""
    codes, owner, size = [], [], 0

    def grams(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank = c == 0
        keep = np.ones(len(c), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (o[1:] == o[:-1]))
        c, o = c[keep], o[keep]
        whole = o[2:] == o[:-2]
        return c, o[2:][whole], (c[:-2] << 2 * SHIFT | c[1:-1] << SHIFT | c[2:])[whole]

    def waiting() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal size
        if codes:
            yield grams(np.concatenate(codes), np.concatenate(owner))[1:]
        codes.clear(), owner.clear()
        size = 0

    for k, text in enumerate(texts):
        low = f" {text.lower()} " if text else "  "
        if len(low) <= CHARS:
            codes.append(_codes(low))
            owner.append(np.full(len(low), k))
            size += len(low)
        else:       # in pieces, each behind the last two letters or blanks before it
            carry = np.empty(0, np.int64)
            for at in range(0, len(low), CHARS):
                c = np.concatenate([carry, _codes(low[at:at + CHARS])])
                c, *found = grams(c, np.full(len(c), k))
                yield tuple(found)
                carry = c[-2:]
        if size >= CHARS:
            yield from waiting()
    yield from waiting()


def vectors(codes: np.ndarray) -> np.ndarray:
    """Trigram vectors, one row each."""
    def of(part: np.ndarray, place: int) -> np.ndarray:
        used, at = np.unique(part, return_inverse=True)
        table = np.stack([np.roll(letter(int(c)), place) for c in used])
        return table[at]

    low = (1 << SHIFT) - 1
    made = of(codes >> 2 * SHIFT, 2)
    made *= of(codes >> SHIFT & low, 1)
    made *= of(codes & low, 0)
    return made


def bundles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the sum of its trigrams' vectors, the number of trigrams, and whether any
    has a letter.  ``SLICE`` trigram vectors are held at a time."""
    total = np.zeros((len(texts), DIM))
    size = np.zeros(len(texts), np.int64)
    some = np.zeros(len(texts), bool)
    for owner, codes in trigrams(texts):
        size += np.bincount(owner, minlength=len(texts))
        some[owner[codes != 0]] = True
        used, at = np.unique(codes, return_inverse=True)
        pairs, n = np.unique(at * len(texts) + owner, return_counts=True)   # by trigram
        at, owner = pairs // len(texts), pairs % len(texts)
        for first in range(0, len(used), SLICE):
            of_used = vectors(used[first:first + SLICE]).astype(np.float32)
            begin, end = np.searchsorted(at, [first, first + SLICE])
            order = np.argsort(owner[begin:end], kind="stable") + begin
            mine, ends = at[order] - first, np.searchsorted(owner[order], np.arange(len(texts) + 1))
            count = n[order].astype(np.float32)
            for k in np.unique(owner[begin:end]).tolist():
                total[k] += count[ends[k]:ends[k + 1]] @ of_used[mine[ends[k]:ends[k + 1]]]
    return total, size, some


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of every language in ``docs``, over all rows with text and language.

    Each task counts trigrams and bundles its own rows; Spark adds the bundles up.  The
    driver gets one vector per language.
    """
    small_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            total, size, _ = bundles(texts)
            # Every text weighs the same, so a single long one can't drown the others;
            # rounded for itself, so it adds the same in any batch.
            parts = np.rint(total * (UNIT / np.maximum(size, 1))[:, None]).astype(np.int64)
            for name, part in zip(langs, parts):
                sums[name] = sums.get(name, 0) + part
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)),
                 pa.array(total)], ["lang", "at", "v"])

    known = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull())
    parts = known.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")) \
        .mapInArrow(bundle, "lang string, at int, v bigint")
    total = parts.groupBy("lang", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in total.toLocalIterator():
        out.setdefault(r["lang"], np.zeros(DIM))[r["at"]] = r["v"]
    return dict(sorted(out.items()))


def scores(texts: list, names: list[str], unit: np.ndarray) -> tuple[list, list]:
    """Language and score of each text.  ``unit``: prototypes of length 1, as columns."""
    total, _, some = bundles(texts)
    langs, best = [], []
    for v, any_letter in zip(total, some):
        if not len(names) or not any_letter:
            langs.append(NONE)
            best.append(0.0)
            continue
        cos = v @ unit / max(float(np.linalg.norm(v)), 1e-9)
        top = int(np.argmax(cos))
        langs.append(names[top])
        best.append(float(min(1.0, max(0.0, cos[top]))))
    return langs, best


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its cosine, from 0 to 1.

    ``und`` and 0 for null texts and texts without letters, and where nothing was learned.
    Rows are independent, so ties and repeated rows get equal results; equal cosines go to
    the first name.  ``pred`` and ``score`` must not be columns of ``docs``; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    unit = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names],
                    axis=1).astype(np.float32) if names else np.empty((DIM, 0), np.float32)
    at = docs.columns.index(text)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    numbered = docs.toDF(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, best = scores(batch.column(at).to_pylist(), names, unit)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                names=[*columns, "p", "s"])

    schema = StructType([StructField(c, f.dataType) for c, f in zip(columns, docs.schema)]) \
        .add("p", "string").add("s", "double")
    return numbered.mapInArrow(run, schema).toDF(*docs.columns, pred, score)


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op7(docs: DataFrame) -> DataFrame:
    learned = profiles(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text")
    return predict(rows, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                                         "lang_pred", "score")


def drop_unknown(docs: DataFrame, least: float = NOISE, sure: int = SURE, *,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without texts of no language, learned from all of its labelled rows.

    Texts without letters go, null texts among them, and texts of ``sure`` characters and
    more whose cosine to every language is under ``least``: such a text shares no more
    trigrams with any of them than chance gives.  Shorter texts say too little to be
    rejected.  Without labelled rows there is nothing to compare with, and all texts with
    letters stay.  Repeated rows all stay or all go; very long texts are judged whole; an
    empty table gives no rows; other columns are kept as they are.
    """
    pred, score = free_name(docs, "__lang"), free_name(docs, "__score")
    learned = profiles(docs, text=text, lang=lang)
    near = (F.col(score) >= least) | (F.char_length(f"`{text}`") < sure) if learned else F.lit(True)
    kept = predict(docs, learned or {"any": np.ones(DIM)}, text=text, pred=pred,
                   score=score).where((F.col(pred) != NONE) & near)
    return kept.drop(pred, score)
