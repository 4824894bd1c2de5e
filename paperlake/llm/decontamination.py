"""Benchmark decontamination by latent semantic retrieval.

Benchmark items (in segments of at most ``SEGMENT`` words) are the queries, overlapping
windows of document words are the passages. Passages and segments are TF-IDF vectors over
the terms of the benchmark (damped term frequency, square root); a passage's norm also counts
its other words, at the largest weight. The latent space is a randomised SVD (Halko,
Martinsson and Tropp 2011) of segments and of all documents in passages that do not overlap,
so that each word counts once: tasks add up their part of A'(A Q), a matrix of benchmark
terms by rank, and only that sum reaches the driver, which orthonormalises it. Passages whose
cosine with a segment in that space is large enough are candidates; the longest common
subsequence of their words and an answer check settle them.

Words are numbered by benchmark term once, and that is what is checkpointed: words outside the
benchmark can neither weigh in a vector's entries nor be common to a segment.

The space holds about as many directions as its rank, so with many more segments than that
it cannot hold each of them. What it misses is found by words: the weights of a segment's
rarer words are added up for every segment in every stretch of text (``Counted``), whatever the
number of segments and the rank; stretches with at least half of a segment's weight are candidates.

A projection never lengthens a vector, so the cosine cannot exceed the share of the
passage's norm that lies on benchmark terms: windows below the limit are left out before
anything is projected, without losing a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, columns_of, documents, free_names, keyed_text, raw_texts, row_key, slices

#: Window lengths in words and their strides: the short ones suit items of few words.
WINDOWS = ((16, 4), (32, 8))
#: Passages for the SVD, each word once.
APART = ((32, 32),)
MARGIN, SEGMENT = 64, 64
#: Benchmark text handled at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 1 << 20
RANK, OVERSAMPLING, POWER = 128, 8, 2
TASKS_PER_CORE = 4
#: A word in fewer than one of so many documents weighs as one in so many.
RAREST = 10_000
#: Words to a block in which the weights of a segment's words are added up.
BLOCK = 32
#: Lower-case words without ASCII punctuation.
PLAIN = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b in b" ") else 32 if b < 128 else b for b in range(256))


@dataclass(frozen=True)
class Limits:
    """Least cosine of a candidate; least shares of a segment's words in common order and of its answer."""

    cosine: float = 0.4
    certain: float = 0.8
    common: float = 0.5
    answer: float = 0.5


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(PLAIN).split()


@dataclass
class Segment:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


def segments_of(item_id: int, raw: bytes | None) -> list[Segment]:
    """Segments of near equal length. The answer is what follows a last question mark, or else the last quarter."""
    words = words_of(raw)
    if not words:
        return []
    tail = words_of((raw or b"").rpartition(b"?")[2]) if b"?" in (raw or b"") else []
    count = -(-len(words) // SEGMENT)
    edges = [round(k * len(words) / count) for k in range(count + 1)]
    found = []
    for a, b in zip(edges, edges[1:]):
        part = words[a:b]
        own = tail if tail and b == len(words) and len(tail) < len(part) else part[-max(1, len(part) // 4) :]
        found.append(Segment(item_id, part, own))
    return found


class Vocabulary:
    """Words by number; number ``outside`` stands for any other word."""

    def __init__(self, words: set[bytes]) -> None:
        self.number = {w: i for i, w in enumerate(sorted(words))}
        self.outside = len(self.number)
        self.kind = np.dtype("<u2" if self.outside < 1 << 16 else "<u4")

    def indices(self, words: list[bytes]) -> np.ndarray:
        get, out = self.number.get, self.outside
        return np.array([get(w, out) for w in words], self.kind)


class Terms(Vocabulary):
    """Benchmark terms by number with their weights; number ``outside`` stands for any other word."""

    def __init__(self, segments: list[Segment]) -> None:
        super().__init__({w for s in segments for w in s.words})
        self.segments = segments
        self.idf = np.ones(self.outside + 1)

    def weigh(self, frequency: np.ndarray, total: int) -> None:
        """Smoothed idf; the last entry is the weight of words outside the benchmark.

        No word weighs more than one in ``RAREST`` documents: an unseen word's weight would
        grow with the corpus while that of a term of steady share does not.
        """
        self.idf = np.minimum(np.log((total + 1) / (np.append(frequency, 0) + 1)), np.log(RAREST)) + 1

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each segment, of unit length."""
        found = []
        for s in self.segments:
            terms, count = np.unique(self.indices(s.words), return_counts=True)
            weight = np.sqrt(count) * self.idf[terms]
            found.append((terms, weight / np.linalg.norm(weight)))
        return found


class Common:
    """Longest common subsequence with one sequence, by bit-parallel steps (Hyyroe 2004)."""

    def __init__(self, query: list) -> None:
        self.size = len(query)
        self.masks: dict = {}
        for i, w in enumerate(query):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def length(self, words: list) -> int:
        full = (1 << self.size) - 1
        row = full
        for match in map(self.masks.get, words):
            if match:
                u = row & match
                row = ((row + u) | (row - u)) & full
        return self.size - row.bit_count()


def longest_common(query: list, words: list) -> int:
    return Common(query).length(words)


def windows_of(n: int, windows: tuple[tuple[int, int], ...] = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of n words; the last of each length ends with the text."""
    starts, ends = [], []
    for length, stride in windows:
        at = np.append(np.arange(0, n - length, stride), n - length) if n > length else np.zeros(1, np.int64)
        starts.append(at)
        ends.append(np.minimum(at + length, n))
        if n <= length:
            break
    return np.concatenate(starts), np.concatenate(ends)


INDEXED = "doc_id long, terms binary"


def indexed(docs: DataFrame, terms: Vocabulary) -> DataFrame:
    """Whole texts as term numbers; documents without a benchmark term have nothing to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [terms.indices(words_of(raw)) for raw in raw_texts(part)]
            some = np.array([len(x) > 0 and int(x.min()) < terms.outside for x in found])
            data = pa.array([x.tobytes() if k else None for x, k in zip(found, some, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), data], ["doc_id", "terms"]).filter(pa.array(some))

    return docs.mapInArrow(run, INDEXED)


def benchmark_words(items: DataFrame) -> Vocabulary:
    """All words of the benchmark: what reaches the driver, and each task, grows with its vocabulary and not with its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = {w for raw in raw_texts(part) for w in words_of(raw)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["word"])

    rows = items.select("text").mapInArrow(run, "word binary").distinct().toLocalIterator()
    return Vocabulary({bytes(r.word) for r in rows})


def renumbered(whole: DataFrame, every: Vocabulary, terms: Terms) -> DataFrame:
    """Documents numbered by the words of the whole benchmark as ``indexed`` numbers them for one block of it."""
    place = np.full(every.outside + 1, terms.outside, terms.kind)
    place[[every.number[w] for w in terms.number]] = np.arange(terms.outside, dtype=terms.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="terms"):
            found = [place[np.frombuffer(raw, every.kind)] for raw in part.column("terms").to_pylist()]
            some = np.array([int(x.min()) < terms.outside for x in found], bool)
            data = pa.array([x.tobytes() if k else None for x, k in zip(found, some, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), data], ["doc_id", "terms"]).filter(pa.array(some, pa.bool_()))

    return whole.mapInArrow(run, INDEXED)


def term_frequencies(found: DataFrame, terms: Terms) -> np.ndarray:
    """Documents that hold each benchmark term: one sum a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(terms.outside + 1, np.int64)
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                count[np.unique(np.frombuffer(raw, terms.kind))] += 1
        used = np.flatnonzero(count[: terms.outside])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], ["term", "n"])

    out = np.zeros(terms.outside, np.int64)
    for r in found.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


@dataclass
class Passages:
    """Windows of a slice of documents that may reach the least cosine."""

    index: np.ndarray
    first: np.ndarray
    last: np.ndarray
    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    norm: np.ndarray

    def vectors(self, terms: Terms, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, terms, weights), one row a window: the k-th occurrence of a term adds sqrt(k) - sqrt(k - 1)."""
        length = self.end - self.start
        for low, high in zip((0, *(n for n, _ in WINDOWS)), (n for n, _ in WINDOWS)):
            mine = np.flatnonzero((length > low) & (length <= high))
            place = np.arange(high)
            for i in range(0, len(mine), at_once):
                rows = mine[i : i + at_once]
                at = self.start[rows, None] + place
                term = np.where(place < length[rows, None], self.index[np.minimum(at, len(self.index) - 1)], terms.outside)
                term.sort(axis=1)
                nth = np.zeros(term.shape, np.int64)
                for k in range(1, high):
                    nth[:, k] = np.where(term[:, k] == term[:, k - 1], nth[:, k - 1] + 1, 0)
                weight = ROOTS[nth] * np.where(term < terms.outside, terms.idf[term], 0) / self.norm[rows, None]
                yield rows, term, weight.astype(np.float32)


ROOTS = np.sqrt(np.arange(1, 1 + max(n for n, _ in WINDOWS))) - np.sqrt(np.arange(max(n for n, _ in WINDOWS)))


def passages(
    batches: Iterator[pa.RecordBatch], terms: Terms, limits: Limits, windows: tuple[tuple[int, int], ...] = WINDOWS
) -> Iterator[tuple[Passages, pa.RecordBatch]]:
    """Passages of each slice of indexed documents."""
    square = terms.idf**2
    for part in slices(batches, column="terms"):
        texts = [np.frombuffer(raw, terms.kind) for raw in part.column("terms").to_pylist()]
        if not texts:
            continue
        size = np.array([len(t) for t in texts])
        last = np.cumsum(size)
        index = np.concatenate(texts)
        edges = [windows_of(n, windows) for n in size.tolist()]
        document = np.repeat(np.arange(len(texts)), [len(a) for a, _ in edges])
        offset = (last - size)[document]
        start, end = (np.concatenate([e[k] for e in edges]) + offset for k in (0, 1))
        weight = square[index]
        whole = np.concatenate(([0.0], np.cumsum(weight)))
        inside = np.concatenate(([0.0], np.cumsum(np.where(index < terms.outside, weight, 0.0))))
        norm, own = whole[end] - whole[start], inside[end] - inside[start]
        k = np.flatnonzero((own > 1e-9 * norm) & (own >= limits.cosine**2 * norm))
        yield Passages(index, last - size, last, document[k], start[k], end[k], np.sqrt(norm[k])), part


def projected(term: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows of terms and weights times a basis whose last row (other words) is zero."""
    return (weight[:, None, :] @ basis[term])[:, 0, :]


def times_gram(found: DataFrame, terms: Terms, limits: Limits, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """A'(A basis) over all passages without overlap, and their number.

    Each task sends one row of sums a term it has met, so neighbouring partitions are read by
    one task where there are many more of them than cores: the sums follow the cluster's size
    and not the corpus.
    """
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms.outside + 1, width))
        count = 0
        for part, _ in passages(batches, terms, limits, APART):
            for rows, term, weight in part.vectors(terms):
                used, place = np.unique(term, return_inverse=True)
                cell = np.arange(len(rows))[:, None] * len(used) + place.reshape(term.shape)
                dense = np.bincount(cell.ravel(), weight.ravel(), len(rows) * len(used)).reshape(len(rows), -1).astype(np.float32)
                own = used < terms.outside
                used, dense = used[own], dense[:, own]
                total[used] += dense.T @ (dense @ basis[used].astype(np.float32))
                count += len(rows)
        used = np.flatnonzero(total[: terms.outside].any(axis=1))
        sums = np.vstack([total[used], np.full(width, float(count))]).astype(np.float32)
        lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, width, dtype=np.int32), sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array([*used, terms.outside], pa.int32()), lists], ["term", "sums"])

    tasks = TASKS_PER_CORE * found.sparkSession.sparkContext.defaultParallelism
    rows = found.select("terms").coalesce(tasks).mapInArrow(run, "term int, sums array<float>")
    out = np.zeros((terms.outside + 1, width))
    for term, *sums in rows.groupBy("term").agg(*(F.sum(F.col("sums")[k]) for k in range(width))).collect():
        out[term] = sums
    return out[: terms.outside], round(out[terms.outside, 0])


def latent_basis(found: DataFrame, terms: Terms, limits: Limits, rank: int = RANK) -> np.ndarray:
    """Terms by rank: leading right singular vectors of passages and segments; the last row (other words) is zero.

    Segments weigh as much in total as passages do, so that their directions are kept.
    """
    size = terms.outside
    own = terms.vectors()
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((size, min(size, rank + OVERSAMPLING))))[0]
    for step in range(POWER + 1):
        image, total = times_gram(found, terms, limits, basis)
        share = max(1.0, total / len(own))
        for t, w in own:
            image[t] += share * np.outer(w, w @ basis[t])
        if step == POWER:
            values, vectors = np.linalg.eigh(basis.T @ image)
            best = basis @ vectors[:, np.argsort(-values)[:rank]]
            return np.vstack([best, np.zeros(best.shape[1])]).astype(np.float32)
        basis = np.linalg.qr(image)[0]
    raise AssertionError


class Counted:
    """Stretches of text whose words may carry the least share of a segment's squared weight.

    A segment's commonest words, with half of that share between them, are not counted: a stretch
    is taken if the others in it, repeats included, weigh at least the share less those. Stretches
    are whole blocks, enough of them that any passage half as long again as its segment lies in one.
    """

    def __init__(self, terms: Terms, limits: Limits) -> None:
        self.outside = terms.outside
        self.square = terms.idf**2
        self.need, self.blocks = np.zeros(len(terms.segments)), np.zeros(len(terms.segments), np.int64)
        pairs = []
        for k, s in enumerate(terms.segments):
            own, count = np.unique(terms.indices(s.words), return_counts=True)
            order = np.argsort(terms.idf[own], kind="stable")
            weight = np.cumsum((count * self.square[own])[order])
            left_out = int(np.searchsorted(weight, limits.common / 2 * weight[-1], side="right"))
            without = weight[left_out - 1] if left_out else 0.0
            self.need[k] = (limits.common * weight[-1] - without) * (1 - 1e-6)
            n = len(s.words)
            self.blocks[k] = -(-(n + max(8, n // 2)) // BLOCK) + 1
            kept = own[order[left_out:]].astype(np.int64)
            pairs.append(np.stack([kept, np.full(len(kept), k)]))
        term, segment = np.concatenate(pairs, axis=1)
        self.segment = segment[np.argsort(term, kind="stable")]
        self.edge = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=self.outside + 1))))

    def stretches(self, p: Passages) -> Iterator[tuple[int, int, int, int]]:
        """(document, segment, start, end) in a slice of documents, wherever enough weight lies in a segment's blocks.

        Only blocks in which a segment has weight are held; a stretch is named by the first of them
        in it, and begins there or up to as many blocks before as it still holds enough.
        """
        size = p.last - p.first
        count = -(-size // BLOCK)
        offset = np.cumsum(count) - count
        document = np.repeat(np.arange(len(size)), count)
        term = p.index.astype(np.int64)
        weighing = np.flatnonzero(self.edge[term + 1] > self.edge[term])
        own = np.searchsorted(p.last, weighing, side="right")
        block = (weighing - p.first[own]) // BLOCK + offset[own]
        term = term[weighing]
        many = self.edge[term + 1] - self.edge[term]
        place = np.arange(many.sum()) + np.repeat(self.edge[term] - (np.cumsum(many) - many), many)
        rows = len(document) + int(self.blocks.max())
        key, at = np.unique(self.segment[place] * rows + np.repeat(block, many), return_inverse=True)
        total = np.concatenate(([0.0], np.cumsum(np.bincount(at, np.repeat(self.square[term], many), minlength=len(key)))))
        segment, block = key // rows, key % rows
        before = np.where(np.diff(segment, prepend=-1) == 0, np.roll(block, 1), -1)
        long, need = self.blocks[segment], self.need[segment]
        hits = np.flatnonzero(total[np.searchsorted(key, key + long)] - total[:-1] >= need)
        for shift in range(int(long[hits].max()) if len(hits) else 0):
            start = block[hits] - shift
            fits = (shift < long[hits]) & (start > before[hits]) & (start >= offset[document[block[hits]]])
            held = total[np.searchsorted(key, key[hits] - shift + long[hits])] - total[hits]
            for h in hits[fits & (held >= need[hits])].tolist():
                d = int(document[block[h]])
                first = p.first[d] + (block[h] - shift - offset[d]) * BLOCK
                yield d, int(segment[h]), int(first), int(min(p.last[d], first + long[h] * BLOCK))


def share_of_weight(terms: Terms, segment: Segment, words: np.ndarray) -> tuple[float, float]:
    """Share of a segment's squared weight on words that a stretch holds as well, and their plain cosine."""
    term, count = np.unique(terms.indices(segment.words), return_counts=True)
    held = np.bincount(words, minlength=terms.outside + 1)
    square = terms.idf[term] ** 2
    whole = count @ square
    cosine = (np.sqrt(count * held[term]) @ square) / np.sqrt(whole * (held @ terms.idf**2))
    return float(np.minimum(held[term], count) @ square / whole), float(cosine)


FOUND = "doc_id long, item_id long, start int, cosine double, common_share double, answer_share double"


def matches(found: DataFrame, terms: Terms, basis: np.ndarray, limits: Limits) -> DataFrame:
    """Candidates by cosine in the latent space and by weight of words, verified on them."""
    counted = Counted(terms, limits)
    queries = np.array([w @ basis[t] for t, w in terms.vectors()], np.float32)
    queries /= np.maximum(1e-9, np.linalg.norm(queries, axis=1, keepdims=True))
    sought = [(s.item_id, Common(terms.indices(s.words).tolist()), Common(terms.indices(s.answer).tolist())) for s in terms.segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, part in passages(batches, terms, limits):
            out, settled = [], set()
            ids = part.column("doc_id").to_pylist()
            for rows, term, weight in p.vectors(terms):
                cosine = projected(term, weight, basis) @ queries.T
                for i, k in zip(*np.nonzero(cosine >= limits.cosine), strict=True):
                    row = rows[i]
                    d = p.document[row]
                    item_id, whole, answer = sought[k]
                    near = p.index[max(p.first[d], p.start[row] - MARGIN) : min(p.last[d], p.end[row] + MARGIN)].tolist()
                    common = whole.length(near) / whole.size
                    if common < limits.common:
                        continue
                    answered = answer.length(near) / answer.size
                    if common >= limits.certain or answered >= limits.answer:
                        out.append((ids[d], item_id, int(p.start[row] - p.first[d]), float(cosine[i, k]), common, answered))
                        settled.add((d, k))
            for d, k, start, end in counted.stretches(p):
                if (d, k) in settled:
                    continue
                item_id, whole, answer = sought[k]
                near = p.index[start:end].tolist()
                common = whole.length(near) / whole.size
                if common < limits.common:
                    continue
                answered = answer.length(near) / answer.size
                if common >= limits.certain or answered >= limits.answer:
                    share, cosine = share_of_weight(terms, terms.segments[k], p.index[start:end])
                    if share >= limits.common:
                        out.append((ids[d], item_id, int(start - p.first[d]), cosine, common, answered))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                    [c.split()[0] for c in FOUND.split(", ")],
                )

    return found.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Columns: doc_id, item_id, start_word (of the best window), cosine (in the latent space, or
    plain where the passage was found by its words), common_share and
    answer_share (largest over windows). Null and empty texts hold nothing, on either side;
    an empty benchmark or table gives no rows. Repeated rows give one row. A large benchmark is
    searched in blocks of at most ``block_bytes`` of its text (an item is never cut): the documents'
    texts are read once and become numbers of its words, from which each block picks its own.
    """
    docs = keyed_text(docs)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    total = docs.count()
    out = docs.sparkSession.createDataFrame([], FOUND)
    if blocks > 1:
        every = benchmark_words(items)
        whole = checkpointed(indexed(docs, every))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        terms = Terms([s for r in part for s in segments_of(r.item_id, r.text.encode())])
        if not terms.segments:
            continue
        found = renumbered(whole, every, terms) if blocks > 1 else checkpointed(indexed(docs, terms))
        terms.weigh(term_frequencies(found, terms), total)
        out = out.union(matches(found, terms, latent_basis(found, terms, limits), limits))
    best = F.max_by("start", F.struct("common_share", "cosine", -F.col("start"))).alias("start_word")
    return out.groupBy("doc_id", "item_id").agg(best, *(F.max(c).alias(c) for c in ("cosine", "common_share", "answer_share")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that hold no benchmark item.

    Rows are judged by their text and doc_id together (64 bits of both stand for a row), so
    a null doc_id is judged like any other, and so is each text under a repeated doc_id.
    """
    (name,) = free_names(docs, 1)
    keyed = docs.withColumn(name, row_key(docs)[0])
    leaks = contaminated(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return columns_of(keyed.join(leaks, name, "left_anti"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontamination": query}
