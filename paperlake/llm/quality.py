"""Quality rules: base counts, then Jensen-Shannon distance to language references.

Each document becomes two histograms: character classes, and common words (each common word of
any language a bin, all other words one more). The common words of a language are learned from
the whole table: those that make up at least one in ``COMMON`` of its words. A language's
reference is the mean of its documents' histograms over the whole table. The limit of a language
follows the distances of its own documents to the reference: their median and a multiple of the
way from there to the upper quartile, which the far quarter cannot move. A document is rejected
where its distance to its own language's reference (without a known language: to every
reference) is above that limit; histograms of texts below the minimum lengths are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, raw_texts, slices

#: A common word of a language is one of so many of its words at least.
COMMON = 200
#: Bytes of text whose words are counted at once.
COUNTED_BYTES = 4 << 20
SPACE, SYMBOL = 0, 1
CLASSES = ("space", "symbol", "lower", "upper", "letter", "digit", "sentence", "other")
#: Histograms are shares in millionths, so that their sums do not depend on order.
UNIT = 1_000_000


@dataclass(frozen=True)
class Limits:
    """What settles the limits, and the lengths from which a histogram is judged.

    Longest distances kept in any language, multiples of a language's spread, its least value. The
    multiples are set on the labelled documents: of 3,243 good ones 3 go, of 291 poor ones that pass
    the base rule 272, 246 of them by their words.
    """

    class_distance: float = 0.25
    word_distance: float = 0.45
    class_spreads: float = 16.0
    word_spreads: float = 4.0
    least_spread: float = 0.01
    min_chars: int = 200
    min_words: int = 100


def class_of(c: str) -> int:
    if c in " \t\n\v\f\r":
        return SPACE
    if c in "#*$%&|<>":
        return SYMBOL
    if c.isalpha():
        return 2 if c.islower() else 3 if c.isupper() else 4
    if c.isdigit():
        return 5
    return 6 if c in ".,;:!?'\"()-" else 7


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane."""
    return np.array([class_of(chr(i)) if not 0xD800 <= i < 0xE000 else 7 for i in range(1 << 16)], np.uint8)


def class_counts(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    high = codes >= 1 << 16
    classes = class_table()[np.where(high, 0xFFFF, codes)]
    if high.any():
        values, inverse = np.unique(codes[high], return_inverse=True)
        classes[high] = np.array([class_of(chr(v)) for v in values], np.uint8)[inverse]
    return np.bincount(classes, minlength=len(CLASSES))


def repeated_window_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 3:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[k : k + len(twice)] |= twice
    return int(marked.sum())


def word_counts(docs: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """(lang, word, n, size) by slices of documents: occurrences in a slice, and all words of that language there.

    A null word counts all. Without ``words``, words of at least one in ``2 * COMMON`` in their slice;
    else those given for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COUNTED_BYTES):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
            coded = lists.flatten().dictionary_encode()
            where = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            code = coded.indices.to_numpy()
            #: A text may begin or end with white space; that gives no word.
            filled = np.append(pc.binary_length(coded.dictionary).to_numpy() > 0, False)[code]
            names = np.array(part.column("lang").to_pylist(), object)
            rows = []
            for name in sorted(set(names)):
                count = np.bincount(code[filled & (names[where] == name)], minlength=len(coded.dictionary))
                size = int(count.sum())
                rows.append((name, None, size, size))
                if words is None:
                    kept = np.flatnonzero(2 * COMMON * count >= max(1, size))
                else:
                    place = pc.index_in(pa.array(words.get(name, []), pa.string()), coded.dictionary)
                    kept = place.drop_null().to_numpy().astype(np.int64)
                found = coded.dictionary.take(pa.array(kept)).to_pylist()
                rows += [(name, w, int(n), size) for w, n in zip(found, count[kept], strict=True)]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n", "size"])

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    parts = known.mapInArrow(run, "lang string, word string, n long, size long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """Words that make up one in ``COMMON`` of a language's words or more: at most so many a language.

    A word of that share over the table has it in some slice. What slices leave out adds less
    than half of the share, so fewer than ``2 * COMMON`` words a language can still be common after
    a first pass; a second counts those exactly.
    """
    counts = checkpointed(word_counts(docs))
    whole = {r.lang: r.n for r in counts.where("word IS NULL").collect()}
    totals = F.broadcast(counts.where("word IS NULL").select("lang", F.col("n").alias("whole")))
    able = counts.where("word IS NOT NULL").join(totals, "lang").where(2 * COMMON * F.col("n") - F.col("size") >= F.col("whole"))
    candidates: dict[str, list[str]] = {}
    for r in able.select("lang", "word").collect():
        candidates.setdefault(r.lang, []).append(r.word)
    found: dict[str, list[str]] = {}
    for r in word_counts(docs, candidates).where("word IS NOT NULL").collect() if candidates else ():
        if COMMON * r.n >= whole[r.lang]:
            found.setdefault(r.lang, []).append(r.word)
    return found


def measure(raw: bytes, bins: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Base counts, class shares and common-word shares of one whole text."""
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    classes = class_counts(raw)
    lines: set[bytes] = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line in lines:
            repeats += 1
        elif line.strip():
            lines.add(line)
    common = np.zeros(len(bins) + 1, np.int64)
    if words:
        counts = np.bincount(ids)
        for w, i in seen.items():
            k = bins.get(w.lower())
            if k is not None:
                common[k] += counts[i]
        common[len(bins)] = len(words) - common[: len(bins)].sum()
    repeated = repeated_window_words(ids, len(seen))
    base = [len(words), int(classes.sum() - classes[SPACE]), int(classes[SYMBOL]), repeats, repeated]
    share = lambda h: (h * UNIT // max(1, h.sum())).tolist()
    return base, share(classes), share(common)


def narrowed(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang (null where there is no such column)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def features(docs: DataFrame, bins: dict[bytes, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [measure(raw or b"", bins) for raw in raw_texts(part)]
            base = [pa.array(x, pa.int64()) for x in zip(*(r[0] for r in rows), strict=True)]
            arrays = [part.column("doc_id"), part.column("lang"), *base]
            for k in (1, 2):  # bins that are not empty, and what they hold
                held = [np.flatnonzero(r[k]) for r in rows]
                arrays += [pa.array(held, pa.list_(pa.int32())), pa.array([np.array(r[k])[at] for r, at in zip(rows, held)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", *COUNTS, "classes_at", "classes", "common_at", "common"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    kinds = ", ".join(f"{c}_at array<int>, {c} array<int>" for c in ("classes", "common"))
    return docs.mapInArrow(run, f"doc_id long, lang string, {counts}, {kinds}")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def references(feats: DataFrame, limits: Limits, words: int) -> dict[str, tuple[list[str], np.ndarray]]:
    """Languages and their mean histograms, (languages, bins), for each kind. One number a language and bin at most."""
    found = {}
    for name, size, judged in (
        ("classes", len(CLASSES), F.col("word_chars") >= limits.min_chars), ("common", words + 1, F.col("n_words") >= limits.min_words)
    ):
        held = F.inline(F.arrays_zip(F.col(f"{name}_at").alias("bin"), F.col(name).alias("share")))
        bins = feats.where(judged & F.col("lang").isNotNull()).select("lang", held)
        rows = bins.groupBy("lang", "bin").agg(F.sum("share").alias("share")).collect()
        languages = sorted({r.lang for r in rows})
        at, sums = {x: i for i, x in enumerate(languages)}, np.zeros((len(languages), size))
        for r in rows:
            sums[at[r.lang], r.bin] = r.share
        found[name] = languages, sums / np.maximum(1, sums.sum(axis=1, keepdims=True))
    return found


#: Distances are counted in steps of one part of so many.
STEPS = 10_000


def limits_by_language(feats: DataFrame, known: dict[str, tuple[list[str], np.ndarray]], limits: Limits) -> dict[str, np.ndarray]:
    """Longest distance kept in each language for each kind, from exact quartiles over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, known):
            for name, (languages, reference) in known.items():
                least, length = (limits.min_chars, "word_chars") if name == "classes" else (limits.min_words, "n_words")
                own = places(part, languages)
                rows = np.flatnonzero((own >= 0) & (part.column(length).to_numpy() >= least))
                if len(rows):
                    to_own = distances(matrix_of(part, name, reference)[rows], reference, own[rows])[np.arange(len(rows)), own[rows]]
                    cell, n = np.unique(own[rows] * (STEPS + 1) + np.rint(to_own * STEPS).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell)), pa.array(cell), pa.array(n)], ["kind", "cell", "n"])

    rows = feats.mapInArrow(run, "kind string, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    found = {}
    for name, most, spreads in (
        ("classes", limits.class_distance, limits.class_spreads), ("common", limits.word_distance, limits.word_spreads)
    ):
        count = np.zeros(len(known[name][0]) * (STEPS + 1), np.int64)
        for r in rows:
            if r.kind == name:
                count[r.cell] = r.n
        held = count.reshape(-1, STEPS + 1).cumsum(axis=1)
        half, upper = ((held >= q * held[:, -1:]).argmax(axis=1) / STEPS for q in (0.5, 0.75))
        found[name] = np.minimum(most, half + spreads * np.maximum(limits.least_spread, upper - half))
    return found


#: Numbers of one matrix of rows by bins, or of rows by languages.
CELLS = 1 << 21


def pieces(batches: Iterator[pa.RecordBatch], known: dict[str, tuple[list[str], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a row for each language or bin stays within ``CELLS`` numbers."""
    rows = max(1, CELLS // max(1, *(n for _, reference in known.values() for n in reference.shape)))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def matrix_of(part: pa.RecordBatch, name: str, reference: np.ndarray) -> np.ndarray:
    """Histograms with their empty bins."""
    at = part.column(f"{name}_at")
    found = np.zeros((part.num_rows, reference.shape[1]), np.int64)
    found[np.repeat(np.arange(part.num_rows), pc.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = part.column(name).flatten().to_numpy()
    return found


def places(part: pa.RecordBatch, languages: list[str]) -> np.ndarray:
    """Place of each row's language, -1 where it has no reference."""
    at = {x: i for i, x in enumerate(languages)}
    return np.array([at.get(x, -1) for x in part.column("lang").to_pylist()], np.int64)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of every row of p to every row of q, one row of q at a time."""

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.sum(x * np.log2(np.where(x > 0, x, 1)), axis=-1)

    of_p = entropy(p)
    found = [np.sqrt(np.maximum(0, entropy((p + r) / 2) - (of_p + entropy(r)) / 2)) for r in q]
    return np.array(found).reshape(len(q), len(p)).T


def distances(shares: np.ndarray, reference: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance of each row to the reference of its language ``own``, to all of them where that is -1; else infinite."""
    part = shares / np.maximum(1, shares.sum(axis=1, keepdims=True))
    found = np.full((len(shares), len(reference)), np.inf)
    for k in range(len(reference)):
        rows = np.flatnonzero((own == k) | (own < 0))
        found[rows, k] = jensen_shannon(part[rows], reference[k : k + 1])[:, 0]
    return found


def judged_by(shares: np.ndarray, reference: np.ndarray, most: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each row to its own language, or without one to the nearest, and whether it is too far."""
    if not len(reference) or not len(shares):
        return np.zeros(len(shares)), np.zeros(len(shares), bool)
    found = distances(shares, reference, own)
    rows, at = np.arange(len(found)), np.maximum(own, 0)
    return np.where(own >= 0, found[rows, at], found.min(axis=1)), np.where(
        own >= 0, found[rows, at] > most[at], (found > most).all(axis=1)
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: base counts, base_failed, kept, class_distance, word_distance.

    Null and empty texts have no words and fail the base rule. Distances are null where the
    text is below the minimum length; they are to the document's own language, or to the nearest
    where that is not known. Without any language there is no reference and the
    base rule alone decides. Repeated rows are judged alike, and each text under one doc_id by itself.
    """
    narrow = narrowed(docs)
    learned = sorted({w for words in common_words(narrow).values() for w in words})
    feats = checkpointed(features(narrow, {w.encode(): i for i, w in enumerate(learned)}))
    known = references(feats, limits, len(learned))
    most = limits_by_language(feats, known, limits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, known):
            column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            words = column("n_words")
            failed = (words < 50) | (100 * column("n_repeat_words") > 50 * words)
            (by_class, far_class), (by_word, far_word) = (
                judged_by(matrix_of(part, c, known[c][1]), known[c][1], most[c], places(part, known[c][0])) for c in ("classes", "common")
            )
            judged = column("word_chars") >= limits.min_chars, words >= limits.min_words
            far = judged[0] & far_class | judged[1] & far_word
            arrays = [part.column(c) for c in ("doc_id", *COUNTS)] + [
                pa.array(failed),
                pa.array(~failed & ~far),
                pa.array(by_class, mask=~judged[0]),
                pa.array(by_word, mask=~judged[1]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance"])

    return feats.mapInArrow(
        judge,
        "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op9_quality_rules": query}
