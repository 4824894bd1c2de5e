"""Language-model scores from a weighted backoff automaton learned on the corpus itself.

The model is a word trigram smoothed by Dirichlet priors, each order by the one below it
(MacKay and Peto 1995):

    P(w)     = (c(w) + 1/2) / (N + (V + 1) / 2)
    P(w | b) = (c(b w) + K P(w)) / (c(b) + K)
    P(w | a b) = (c(a b w) + L P(w | b)) / (c(a b) + L)

As an automaton: the root, each word and each pair of words seen in training (and the start of a
text) are states. A seen n-gram is an arc from the state of all its words but the last, with
its log10 probability as weight, to the longest state that ends it. Where a state has no arc for a
word, its failure arc leads to the state without its first word, with weight log10 L / (c(a b) + L)
from a pair and log10 K / (c(b) + K) from a word; the root has an arc for every word. A text is
read once from left to right, the state carried along.

Neither the counts nor the automaton fit into one task, so documents are gathered into blocks
of bounded size where they are read, packed and written as a table bucketed by block; nothing is
dealt by a key. A block asks for its distinct n-grams only: sorted hashes, cut into ranges
(buckets) and stored as differences. There are as many buckets as blocks, so a bucket's part stays
of one size as the corpus grows; a block that has fewer n-grams than there are buckets asks one
row an n-gram at most, which is what a plain join on n-grams would shuffle. Each bucket adds up
the training counts over all blocks and answers every block in the order in which it asked.
With the answers a block holds exactly the part of the automaton that its texts can reach. Hashes
have ``SPARE_BITS`` more bits than it takes to number the bytes of the corpus (64 at most), so an
n-gram shares its hash with another with a chance of less than two in a million at every size.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, documents, keyed_text, listed, remove_folder, shared_folder, slices

PAIR_PRIOR, TRIPLE_PRIOR = 1000.0, 100.0
BLOCK_BYTES = 4 << 20
#: Files' buckets at most, which Spark limits; beyond that a bucket holds several blocks.
MOST_BUCKETS = 100_000
SPARE_BITS = 20
FOLDS, HELD_OUT = 5, 1
START, END = 0, 1


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Block:
    """Tokens of a block's texts, and its distinct n-grams by order, each in the order of hashes.

    ``hashes[k]`` are the distinct hashes of order k, ``of[k]`` the place of each token's n-gram among
    them, ``at[k]`` (from pairs on) a token that ends each. Triples end at tokens that are not the first of a text.
    """

    def __init__(self, texts: pa.Array, bits: int = 64, orders: tuple[int, ...] = (1, 2, 3)) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        filled = (pc.binary_length(coded.dictionary).to_numpy() > 0)[word] if len(word) else np.zeros(0, bool)
        word, text = word[filled], text[filled]
        self.lengths = np.bincount(text, minlength=len(texts)) + 1  # tokens with the end, without the start
        self.first = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        self.token = np.full(n, END)
        own = np.ones(n, bool)
        own[self.first + self.lengths - 1] = False
        self.token[own] = word + 2
        self.before = np.concatenate(([START], self.token[:-1]))
        self.before[self.first] = START
        digest = xxhash.xxh64_intdigest
        words = np.array([*map(digest, listed(coded.dictionary))], np.uint64)
        of_word = np.concatenate((mixed(np.zeros(2, np.uint64), np.array([1, 2], np.uint64)), mixed(words, np.uint64(3))))
        self.kinds = len(of_word)
        self.later = np.ones(n, bool)
        self.later[self.first] = False
        later = np.flatnonzero(self.later)
        shift = np.uint64(64 - bits)
        self.hashes, self.of, self.at = {}, {}, {}
        #: The words are numbered already: only the distinct ones are sorted.
        self.hashes[1], place = np.unique(of_word >> shift, return_inverse=True)
        self.of[1] = place[self.token]
        if max(orders) > 1:
            pair = mixed(of_word[self.before], of_word[self.token])
            triple = mixed(pair[later - 1], of_word[self.token[later]])
            self.hashes[2], self.at[2], self.of[2] = np.unique(pair >> shift, return_index=True, return_inverse=True)
            self.hashes[3], at, self.of[3] = np.unique(triple >> shift, return_index=True, return_inverse=True)
            self.at[3] = later[at]

    def counts(self, training: np.ndarray) -> dict[int, np.ndarray]:
        """Occurrences of the n-grams of each order in training texts; at 0 the number of these texts."""
        use = np.repeat(training, self.lengths)
        found = {0: np.array([training.sum()])}
        for k in self.hashes:
            found[k] = np.bincount(self.of[k][use if k < 3 else use[self.later]], minlength=len(self.hashes[k]))
        return found


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed; planes of zeros at the top are left out."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    many = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return zlib.compress(bytes([many]) + planes[:many].tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


PACKED = "block long, documents binary"


def pack(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Whole documents gathered into blocks of about ``block_bytes`` of text, compressed; one longer text is a block of its own."""
    partition, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packed_block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        row = [pa.array([partition << 33 | count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["block", "documents"])

    for part in slices(batches, block_bytes):
        n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        if held and size + n > block_bytes:
            yield packed_block()
            count, held, size = count + 1, [], 0
        held.append(part)
        size += n
    if held:
        yield packed_block()


def unpack(documents: bytes) -> pa.RecordBatch:
    """All rows of a block: doc_id, text, training."""
    return pa.ipc.open_stream(documents).read_all().combine_chunks().to_batches()[0]


def bucket_runs(hashes: np.ndarray, buckets: int, bits: int) -> list[tuple[int, slice]]:
    """Sorted hashes by range of value: the ranges (of ``buckets`` equal ones) that hold any, in order."""
    number = ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    found, first = np.unique(number, return_index=True)
    edges = [*first.tolist(), len(hashes)]
    return [(b, slice(*x)) for b, *x in zip(found.tolist(), edges, edges[1:])]


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for (_, t), x in zip(fields, columns, strict=True)], [n for n, _ in fields])


ASKED = "block long, bucket int, kind int, hashes binary, counts binary"


def ask(batches: Iterator[pa.RecordBatch], buckets: int, bits: int, kinds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """What each block holds of the n-grams of some orders, by bucket; order 0 is its number of training texts."""
    for row in (r for b in batches for r in b.to_pylist()):
        batch = unpack(row["documents"])
        block = Block(batch.column("text"), bits, kinds)
        counts = block.counts(batch.column("training").to_numpy(zero_copy_only=False))
        rows = [(row["block"], 0, 0, b"", packed(counts[0]))] if 1 in kinds else []
        for kind in kinds:
            hashes = block.hashes[kind]
            for b, part in bucket_runs(hashes, buckets, bits):
                steps = np.diff(hashes[part], prepend=np.uint64(0))
                rows.append((row["block"], b, kind, packed(steps), packed(counts[kind][part])))
        yield rows_of(rows, ASKED)


#: block -1: totals of a bucket, as (training tokens, distinct words, training texts).
ANSWERED = "block long, bucket int, kind int, counts binary"


def answer(table: pa.Table) -> pa.Table:
    rows, totals = [], [0, 0, 0]
    columns = {c: table.column(c).to_pylist() for c in ("block", "bucket", "kind", "hashes", "counts")}
    bucket = columns["bucket"][0]
    for kind in (0, 1, 2, 3):
        mine = [i for i, k in enumerate(columns["kind"]) if k == kind]
        counts = [unpacked(columns["counts"][i]) for i in mine]
        if kind == 0:
            totals[2] = int(sum(c.sum() for c in counts))
            continue
        if not mine:
            continue
        hashes = [np.cumsum(unpacked(columns["hashes"][i]), dtype=np.uint64) for i in mine]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        if kind == 1:
            totals[:2] = int(total.sum()), int((total > 0).sum())
        at = 0
        for i, h in zip(mine, hashes, strict=True):
            rows.append((columns["block"][i], bucket, kind, packed(total[place[at : at + len(h)]])))
            at += len(h)
    rows.append((-1, bucket, 0, packed(np.array(totals))))
    return pa.Table.from_batches([rows_of(rows, ANSWERED)])


#: Weight of an arc that is not there: no log10 probability is above 0.
NO_ARC = 1.0


class Automaton:
    """The states and arcs that one block can reach, with the counts of its n-grams over all training texts."""

    def __init__(
        self,
        block: Block,
        counts: dict[int, np.ndarray],
        starts: int,
        tokens: int,
        distinct: int,
        priors: tuple[float, float],
    ) -> None:
        one, two, three = (counts[k] for k in (1, 2, 3))
        self.block = block
        self.known = one > 0
        root = (one + 0.5) / (tokens + 0.5 * (distinct + 1))
        #: A pair's first word as context: all its occurrences, for the start those of all texts.
        first = block.before[block.at[2]]
        place = np.zeros(block.kinds, np.int64)
        place[block.token] = block.of[1]
        visits = np.where(first == START, starts, one[place[first]])
        pair = (two + priors[0] * root[block.of[1][block.at[2]]]) / (visits + priors[0])
        context = two[block.of[2][block.at[3] - 1]]
        triple = (three + priors[1] * pair[block.of[2][block.at[3]]]) / (context + priors[1])
        self.root = np.log10(root)
        self.pair = np.where(two > 0, np.log10(pair), NO_ARC)
        self.triple = np.where(three > 0, np.log10(triple), NO_ARC)
        self.start_failure = float(np.log10(priors[0] / (starts + priors[0])))
        self.word_failure = np.log10(priors[0] / (one + priors[0]))
        self.pair_failure = np.log10(priors[1] / (two + priors[1]))
        self.is_pair_state = two > 0

    def weights(self, low: int, high: int) -> list[list]:
        """For tokens ``low`` to ``high``: arcs from a pair, a word and the root; failure arcs and words of the state after it; whether a text ends."""
        block = self.block
        word, pair = block.of[1][low:high], block.of[2][low:high]
        triple = np.full(high - low, NO_ARC)
        later = block.later[low:high]
        done = int(block.later[:low].sum())
        triple[later] = self.triple[block.of[3][done : done + int(later.sum())]]
        order = np.where(self.is_pair_state[pair], 2, self.known[word].astype(np.int64))
        found = (
            triple,
            self.pair[pair],
            self.root[word],
            self.pair_failure[pair],
            self.word_failure[word],
            order,
            block.token[low:high] == END,
        )
        return [x.tolist() for x in found]

    def traverse(self, at_once: int = 1 << 16) -> list[float]:
        """Log10 probability of each text: its tokens in order, the state carried from one to the next.

        ``order`` words make up the state: the last pair, the last word (or the start), or none.
        """
        scores: list[float] = []
        total, order, from_pair, from_word = 0.0, 1, 0.0, self.start_failure
        for low in range(0, len(self.block.token), at_once):
            for weight, pair, root, after_pair, after_word, longest, ends in zip(
                *self.weights(low, min(low + at_once, len(self.block.token)))
            ):
                if order == 2 and weight > 0:
                    total += from_pair
                    order = 1
                if order == 1:
                    weight = pair
                    if weight > 0:
                        total += from_word
                        order = 0
                if order == 0:
                    weight = root
                total += weight
                order, from_pair, from_word = longest, after_pair, after_word
                if ends:
                    scores.append(total)
                    total, order, from_word = 0.0, 1, self.start_failure
        return scores

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Base score and known tokens of each text."""
        word, first = self.block.of[1], self.block.first
        return np.add.reduceat(self.root[word], first), np.add.reduceat(self.known[word].astype(np.int64), first)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """Written once as a table whose files are bucketed by ``key``, so that grouping by it moves nothing; and its name.

    The table lies in the shared folder until ``dropped`` removes it.
    """
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def dropped(spark: SparkSession, name: str) -> None:
    """Remove a table of ``bucketed``, files and all."""
    spark.sql(f"DROP TABLE {name}")
    remove_folder(spark, f"{shared_folder(spark)}/{name}")


def score_documents(
    docs: DataFrame,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    priors: tuple[float, float] = (PAIR_PRIOR, TRIPLE_PRIOR),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(doc_id) mod ``folds`` is not ``held_out`` (a null doc_id
    is learned from). Null texts count as empty: one end token. Repeated rows count as
    often as they occur, and each text under one doc_id is scored by itself. An empty table gives no rows.
    """
    remainder = F.coalesce(crc_mod("doc_id", folds), F.lit(-1))
    narrow = keyed_text(docs).withColumn("training", remainder != held_out)
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, max(32, size.bit_length() + SPARE_BITS))
    files = min(MOST_BUCKETS, max(size // block_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    packs, name = bucketed(narrow.mapInArrow(lambda batches: pack(batches, block_bytes), PACKED), "block", files)
    buckets = max(1, packs.count())

    def answers(*kinds: int) -> DataFrame:
        asked = packs.select("block", "documents").mapInArrow(lambda batches: ask(batches, buckets, bits, kinds), ASKED)
        return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)

    words = checkpointed(answers(1))
    #: One short row a bucket; only their sums reach the driver.
    whole = F.udf(lambda x: unpacked(x).tolist(), "array<long>")
    stats = words.where("block = -1").select(whole("counts").alias("c"))
    tokens, distinct, starts = stats.agg(*(F.coalesce(F.sum(F.col("c")[k]), F.lit(0)) for k in range(3))).first()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORED.split(", ")]
        if not left.num_rows:
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], t) for t in types], names)
        batch = unpack(left.column("documents")[0].as_py())
        block = Block(batch.column("text"), bits)
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "counts")), strict=True))
        counts = {
            k: np.concatenate(
                [np.zeros(0, np.uint64), *(unpacked(c) for kind, _, c in parts if kind == k)]
            ).astype(np.int64) for k in (1, 2, 3)
        }
        machine = Automaton(block, counts, starts, tokens, distinct, priors)
        base, known = machine.sums()
        training = batch.column("training").to_numpy(zero_copy_only=False)
        every = np.full(len(base), tokens)
        return pa.table([batch.column("doc_id"), *map(pa.array, (~training, block.lengths, known, every, base, machine.traverse()))], names)

    told = words.where("block >= 0").unionByName(answers(2, 3).where("block >= 0"))
    #: One short row a document; with them written, the blocks, which hold all texts, can go.
    scored = checkpointed(packs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, SCORED))
    dropped(docs.sparkSession, name)
    return scored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op2_lm_scoring": query}
