"""Language identification with hyperdimensional profiles.

Every letter has a seeded random vector of plus and minus ones. A three-letter n-gram is
the product of its letters' vectors, each rotated by its place; a text is the sum of its
n-grams' vectors, and a language's prototype is the sum over its training texts. A text
gets the language whose prototype has the largest cosine with it. Sums are of whole
numbers, so a prototype does not depend on the order in which tasks add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, in_slices, raw_texts, slices

DIMENSIONS = 1024
SEED = 20_240_517
UNKNOWN = "und"
#: Cells of one count matrix (documents by n-grams) that a task holds at a time.
CELLS = 4_000_000
#: Symbols of one text that are counted at once.
STRETCH = 1 << 20


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: its lower-case letter, or 0."""

    def symbol(i: int) -> int:
        c = chr(i)
        return ord(c.lower()[0]) if c.isalpha() else 0

    return np.array([0 if 0xD800 <= i < 0xE000 else symbol(i) for i in range(1 << 16)], np.uint16)


def symbols(text: str) -> np.ndarray:
    """Letters of a text with one 0 before, between and after its words.

    Letters beyond the basic plane share the 6,400 symbols of its private area.
    """
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    high = codes >= 1 << 16
    out = letter_table()[np.where(high, 0, codes)]
    if high.any():
        out[high] = [0xE000 + ord(c.lower()[0]) % 6400 if (c := chr(x)).isalpha() else 0 for x in codes[high]]
    keep = out != 0
    keep[0] = True
    keep[1:] |= out[:-1] != 0
    return out[keep]


@lru_cache(maxsize=100_000)
def letter_vector(symbol: int) -> np.ndarray:
    return (np.random.default_rng([SEED, symbol]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)


def ngram_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of streams of symbols: alphabet; n-grams as rows of three alphabet indices; then stream and n-gram of each occurrence."""
    stream = np.concatenate(parts)
    document = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    used = np.zeros(1 << 16, bool)
    used[stream] = True
    used[0] = True
    alphabet = np.flatnonzero(used)
    index = np.zeros(1 << 16, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    a = index[stream]
    n = len(alphabet)
    code = ((a[:-2] * n) + a[1:-1]) * n + a[2:]
    same = document[:-2] == document[2:]
    code, document = code[same], document[:-2][same]
    if n**3 <= 1 << 22:
        present = np.zeros(n**3, bool)
        present[code] = True
        grams = np.flatnonzero(present)
        place = np.zeros(n**3, np.int32)
        place[grams] = np.arange(len(grams))
        gram = place[code].astype(np.int64)
    else:
        grams, gram = np.unique(code, return_inverse=True)
    return alphabet, np.stack([grams // (n * n), grams // n % n, grams % n], axis=1), document, gram


def bundle(groups: np.ndarray, count: int, alphabet: np.ndarray, grams: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Sums of n-gram vectors by group: (count, DIMENSIONS), whole numbers."""
    letters = np.stack([letter_vector(int(s)) for s in alphabet])
    places = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]
    out = np.zeros((count, DIMENSIONS), np.float64)
    step = 2048
    rows = max(1, CELLS // max(1, len(grams)))
    order = np.argsort(groups, kind="stable")
    groups, gram = groups[order], gram[order]
    edges = np.searchsorted(groups, np.arange(0, count + rows, rows))
    for k, first in enumerate(range(0, count, rows)):
        part = slice(edges[k], edges[k + 1])
        high = min(rows, count - first)
        counts = np.bincount(
            (groups[part] - first) * len(grams) + gram[part], minlength=high * len(grams)
        ).reshape(high, -1).astype(np.float32)
        for g in range(0, len(grams), step):
            i = grams[g : g + step]
            vectors = places[0][i[:, 0]] * places[1][i[:, 1]] * places[2][i[:, 2]]
            out[first : first + high] += counts[:, g : g + step] @ vectors.astype(np.float32)
    return out


def text_vectors(texts: list[str]) -> np.ndarray:
    """Sum of n-gram vectors of each text; a very long one is counted in stretches that overlap by two symbols."""
    out = np.zeros((len(texts), DIMENSIONS))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def add() -> None:
        alphabet, grams, piece, gram = ngram_counts([s for _, s in held])
        for (i, _), vector in zip(held, bundle(piece, len(held), alphabet, grams, gram), strict=True):
            out[i] += vector

    for i, text in enumerate(texts):
        stream = symbols(text)
        for first in range(0, max(1, len(stream) - 2), STRETCH):
            piece = stream[first : first + STRETCH + 2]
            if held and size + len(piece) > 2 * STRETCH:
                add()
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        add()
    return out


def total_vector(texts: list[str]) -> np.ndarray:
    """Sum of the n-gram vectors of all texts: streams in groups of bounded size, counted together."""
    out, held, size = np.zeros(DIMENSIONS), [], 0

    def add() -> np.ndarray:
        alphabet, grams, piece, gram = ngram_counts(held)
        return bundle(np.zeros_like(piece), 1, alphabet, grams, gram)[0]

    for text in texts:
        stream = symbols(text)
        for first in range(0, max(1, len(stream) - 2), STRETCH):
            if held and size > STRETCH:
                out += add()
                held, size = [], 0
            held.append(stream[first : first + STRETCH + 2])
            size += len(held[-1])
    return out + add() if held else out


def decoded(raw: list[bytes | None]) -> list[str]:
    return [(x or b"").decode("utf-8") for x in raw]


def chosen(texts: list[str], names: list[str], unit: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text: the first of the prototypes (unit vectors) with the largest cosine."""
    if not names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    v = text_vectors(texts)
    cosine = v @ unit.T / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
    known = [any(map(str.isalpha, t)) for t in texts]
    return [names[best[i]] if k else UNKNOWN for i, k in enumerate(known)], [float(score[i]) if k else 0.0 for i, k in enumerate(known)]


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their vectors: one vector a language reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            names = np.array(part.column("lang").to_pylist(), object)
            texts = decoded(raw_texts(part))
            for name in sorted(set(names)):
                joined = [texts[i] for i in np.flatnonzero(names == name)]
                sums[name] = sums.get(name, 0) + np.rint(total_vector(joined)).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "vector"]
            )

    partial = training.select("lang", "text").mapInArrow(run, "lang string, vector array<long>")
    rows = partial.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    listed = F.sort_array(F.collect_list(F.struct("at", "x"))).getField("x")
    whole = rows.groupBy("lang").agg(listed.alias("vector")).orderBy("lang").collect()
    return [r.lang for r in whole], np.array([r.vector for r in whole], float)


def learned(docs: DataFrame, folds: int = 5) -> tuple[DataFrame, list[str], np.ndarray]:
    """Documents with text, lang and held_out; languages and their prototypes as unit vectors."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
    )
    names, vectors = prototypes(narrow.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    unit = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True)) if names else vectors
    return narrow, names, unit


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of documents whose crc32(doc_id) mod ``folds`` is not
    0 (a null doc_id is never held out). score is the cosine with the chosen prototype, at
    least 0. Null texts, texts without a letter, and all texts where nothing could be
    learned, get ``und`` and 0. Ties go to the first language in order; repeated rows agree,
    and different texts under one doc_id are judged each by itself.
    """
    narrow, names, unit = learned(docs, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found, scores = chosen(decoded(raw_texts(part)), names, unit)
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return narrow.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: Cosine below which no language is taken to be present: 1.6 deviations of the cosine of unrelated vectors.
#: Documents of one or two words in a known language reach down to 0.067, so more would cost clean ones.
MIN_SCORE = 0.05


def keep_known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """All columns of the documents whose language is recognised: not ``und``, score high enough.

    Each row is judged where it is read, by its own text: its doc_id may be null or repeated.
    """
    _, names, unit = learned(docs)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        kept: list[bool] = []
        for part in in_slices(texts):
            found, scores = chosen(decoded(part), names, unit)
            kept += [f != UNKNOWN and s >= min_score for f, s in zip(found, scores, strict=True)]
        return pa.array(kept, pa.bool_())

    return docs.where(known(F.col("text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op4_language_id": query}
