"""Token ids as Simple-8b blocks: 64-bit words whose top four bits say how many ids follow.

File format. A table of Parquet part files under the cluster's shared folder, one row per
block of whole documents in ascending doc_id order:

    shard int, block int     place in the global order (shards are ranges of doc_id)
    doc_ids array<long>      documents of the block, in order
    lengths array<long>      ids of each document, end id included
    offsets array<long>      first word of each document within ``words``
    words binary             little-endian unsigned 64-bit words

Every document starts at a word of its own, so any one can be decoded from its offset.
Selectors 2 to 15 pack 60, 30, 20, ... 1 values of 1, 2, 3, ... 60 bits; selector 1 stands
for 120 zeros; selector 0 is the escape, after which one whole word holds a value of more
than 60 bits. The last word of a document may be filled only in part.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keyed_text, listed, shared_folder, slices, stretches

#: Fixed values of the format: (selector, values in a word, bits of each).
SELECTORS = (
    (1, 120, 0),
    (2, 60, 1),
    (3, 30, 2),
    (4, 20, 3),
    (5, 15, 4),
    (6, 12, 5),
    (7, 10, 6),
    (8, 8, 7),
    (9, 7, 8),
    (10, 6, 10),
    (11, 5, 12),
    (12, 4, 15),
    (13, 3, 20),
    (14, 2, 30),
    (15, 1, 60),
)
COUNT = np.zeros(16, np.int64)
BITS = np.zeros(16, np.int64)
for _s, _n, _b in SELECTORS:
    COUNT[_s], BITS[_s] = _n, _b
COUNT[0] = 1
BLOCK_BYTES = 4 << 20
#: Bytes of input for a range of documents, about; files hold texts in a few times less.
RANGE_BYTES = 64 << 20
#: Distinct words whose ids a Python worker remembers; beyond that it starts anew.
CACHE_ENTRIES = 600_000
END_ID = 2


def choose_selectors(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a word that begins at each id: its selector and how many ids it holds, the most that fit.

    A word fits where the next ``run`` ids are narrow enough, which means that they are next
    to each other among the positions of narrow ids.
    """
    n = len(ids)
    limits = np.array([1 << bits for _, _, bits in SELECTORS], np.uint64)
    short = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
    if n and ids.max() < 1 << 16:
        narrowest = short[ids.astype(np.uint16)]
    else:
        narrowest = np.searchsorted(limits, ids, side="right").astype(np.uint8)
    left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(n)).astype(np.int32)
    selector, advance, open_ = np.zeros(n, np.int8), np.ones(n, np.int32), np.ones(n, bool)
    for k, (s, count, _) in enumerate(SELECTORS):
        narrow = np.flatnonzero(narrowest <= k).astype(np.int32)
        run = np.minimum(count, left[narrow])
        padded = np.append(narrow, np.full(count, -1, np.int32))
        fits = padded[np.arange(len(narrow), dtype=np.int32) + run - 1] - narrow == run - 1
        fits &= open_[narrow]
        where = narrow[fits]
        selector[where], advance[where], open_[where] = s, run[fits], False
        if len(narrow) == n:
            break
    return selector, advance


def reached(following: np.ndarray) -> np.ndarray:
    """Places met from 0 on by following each to the next, up to the last one, which follows itself.

    Every sixteenth is found one after the other, those between them all at once.
    """
    end = len(following) - 1
    far = following
    for _ in range(4):
        far = far[far]
    anchors, i = [], 0
    while i < end:
        anchors.append(i)
        i = far.item(i)
    steps = [np.array(anchors, np.int64)]
    for _ in range(15):
        steps.append(following[steps[-1]])
    found = np.stack(steps, axis=1).ravel()
    return found[found < end]


def encode_words(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the documents whose ids are concatenated in ``ids``, and each one's first word."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    selector, advance = choose_selectors(ids, lengths)
    starts = reached(np.append(np.arange(n, dtype=np.int64) + advance, n))
    chosen = selector[starts]
    width = np.where(chosen == 0, 2, 1)
    at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s, count, bits in SELECTORS:
        k = np.flatnonzero(chosen == s)
        if not len(k):
            continue
        value = np.full(len(k), np.uint64(s) << np.uint64(60))
        last = starts[k] + advance[starts[k]]
        for lane in range(count if bits else 0):
            i = starts[k] + lane
            value |= np.where(i < last, ids[np.minimum(i, n - 1)], np.uint64(0)) << np.uint64(lane * bits)
        words[at[k]] = value
    escapes = chosen == 0
    words[at[escapes] + 1] = ids[starts[escapes]]
    first = np.cumsum(lengths) - lengths
    return words, at[np.searchsorted(starts, first)] if n else np.zeros(len(lengths), np.int64)


def decode_words(words: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ids of all documents of a block, concatenated; every lane of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for p in np.flatnonzero(selector == 0):
        if not raw[p]:
            raw[p + 1] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    document = np.searchsorted(offsets, heads, side="right") - 1
    total = np.cumsum(COUNT[selector]) - COUNT[selector]
    head_of = np.searchsorted(heads, offsets)
    place = total - total[head_of][document]
    base = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint64)
    for s in np.unique(selector):
        k = np.flatnonzero(selector == s)
        if s == 0:
            out[base[document[k]] + place[k]] = words[heads[k] + 1]
            continue
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for lane in range(int(COUNT[s]) if bits else 0):
            i = place[k] + lane
            ok = i < lengths[document[k]]
            out[(base[document[k]] + i)[ok]] = (words[heads[k]] >> np.uint64(lane * bits))[ok] & mask
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def word_cache(path: str) -> dict[str, bytes]:
    return {}


#: What a tokenizer file must say for words to be cut and numbered one by one, as below.
PRESUMED = {
    "truncation": None,
    "padding": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(maxsize=2)
def word_by_word(path: str) -> bool:
    """Whether the tokenizer drops white space, never joins across it, and treats plain words as ``encode_new`` does."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    added = [t["content"] for t in rules.get("added_tokens") or ()]
    own = all(not SIMPLE.fullmatch(t) and not re.search(r"\s", t) for t in added)
    return own and not rules["model"].get("dropout") and all(rules.get(k) == v for k, v in PRESUMED.items())


#: Words that normalising only lower-cases and pre-tokenizing cuts into letters and one tail at most.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


@lru_cache(maxsize=2)
def byte_letters(path: str) -> dict[int, str]:
    """How the pre-tokenizer writes the bytes of letters beyond ASCII."""
    letters = [chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha()]
    return {ord(c): tokenizer(path).pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}


def encode_new(words: list[str], path: str, cache: dict[str, bytes]) -> None:
    """Put the ids of words that are not yet in ``cache`` there.

    Plain words go straight to the tokenizer's model, all others through the whole tokenizer,
    joined by spaces, 1,000 to a call.
    """
    model, letters, plain, pack, hard = tokenizer(path).model.tokenize, byte_letters(path), SIMPLE.fullmatch, struct.pack, []
    known = cache.get
    cache[""] = b""
    for w in words:
        if m := plain(w):
            coded = b""
            for part in m.groups():
                part = part.lower()
                ids = known(part)
                if ids is None:
                    found = [t.id for t in model(part if part.isascii() else part.translate(letters))]
                    ids = cache[part] = pack(f"<{len(found)}I", *found)
                coded += ids
            cache[w] = coded
        else:
            hard.append(w)
    for i in range(0, len(hard), 1000):
        part = hard[i : i + 1000]
        coded = tokenizer(path).encode(" ".join(part), add_special_tokens=False)
        ids = np.array(coded.ids, "<u4").tobytes()
        first = np.cumsum([0] + [len(w) + 1 for w in part])
        edges = np.searchsorted([a for a, _ in coded.offsets], first).tolist()
        for w, a, b in zip(part, edges, edges[1:], strict=False):
            cache[w] = ids[4 * a : 4 * b]


def encode_slice(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, concatenated, and the number of ids of each; null texts have none.

    The tokenizer drops white space and never joins across it, so texts are cut at ASCII
    white space and each distinct word is tokenized once for as long as it is remembered.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    distinct = listed(coded.dictionary)
    cache = word_cache(path)
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    encode_new([w for w in distinct if w not in cache], path, cache)
    parts = list(map(cache.__getitem__, distinct))
    table = np.frombuffer(b"".join(parts), "<u4")
    count = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    first = np.cumsum(count) - count
    word = coded.indices.to_numpy()
    many = count[word]
    ends = np.concatenate(([0], np.cumsum(many)))
    ids = table[np.arange(ends[-1]) + np.repeat(first[word] - ends[:-1], many)]
    words = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    return ids, np.diff(ends[words])


def encode_whole(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_slice``, every text by the whole tokenizer: for files that say anything else than ``PRESUMED``."""
    coded = tokenizer(path).encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)
    lengths = np.array([len(c.ids) for c in coded], np.int64)
    return np.fromiter((i for c in coded for i in c.ids), np.uint32, int(lengths.sum())), lengths


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all whole texts with ``end_id`` after each, concatenated, and how many each has.

    A text longer than a block is encoded in stretches that end at white space, where the tokenizer drops that.
    """
    if not word_by_word(path):
        ids, lengths = encode_whole(texts, path)
    elif len(texts) == 1 and texts[0].is_valid and texts[0].as_buffer().size > BLOCK_BYTES:
        each = [encode_slice(pa.array([x], pa.string()), path)[0] for x in stretches(texts[0].as_buffer().to_pybytes(), BLOCK_BYTES)]
        ids, lengths = np.concatenate(each), np.array([sum(map(len, each))])
    else:
        ids, lengths = encode_slice(texts, path)
    with_ends = np.full(len(ids) + len(lengths), end_id, np.uint32)
    own = np.ones(len(with_ends), bool)
    own[np.cumsum(lengths + 1) - 1] = False
    with_ends[own] = ids
    return with_ends, lengths + 1


BLOCK_SCHEMA = "shard int, block int, doc_ids array<long>, lengths array<long>, offsets array<long>, words binary"


def bytes_of(docs: DataFrame) -> int:
    """Bytes of the files that ``docs`` is read from, as the planner knows them; of its texts, counted, where it does not."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 60:
        return known
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write the blocks to ``folder`` in ascending doc_id order.

    Null texts count as empty and hold the end id alone. Documents of equal doc_id stay
    apart, ordered by a hash of their text and then by where they were read, so that rows that repeat
    need not lie in one range; a null doc_id comes first. There are as many ranges as the input needs
    at ``RANGE_BYTES`` each.
    """
    ranged = keyed_text(docs).withColumns({"tie": F.xxhash64("text"), "read_at": F.monotonically_increasing_id()})
    by = ["doc_id", "tie", "read_at"]
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_of(docs) // RANGE_BYTES))
    ordered = ranged.repartitionByRange(count, *by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for block, part in enumerate(slices(batches, BLOCK_BYTES)):
            ids, lengths = encode_texts(part.column("text"), tokenizer_path, end_id)
            words, offsets = encode_words(ids, lengths)
            row = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                *(pa.array([x], pa.list_(pa.int64())) for x in (part.column("doc_id").to_pylist(), lengths, offsets)),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, ["shard", "block", "doc_ids", "lengths", "offsets", "words"])

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (array<int>) as stored in ``folder``."""
    return _read(spark, folder, "ids array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the decoded blocks."""
    return _read(spark, folder, "ids_crc32 long")


def _read(spark: SparkSession, folder: str, column: str) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    totals = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("shard", "block", totals.alias("n"))
    #: One row a shard: as many as there are range partitions.
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    within = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "block", F.coalesce(within, F.lit(0)).alias("within"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("within") + F.col("shard_start")).alias("block_start"))
    name = column.split()[0]
    digest = name == "ids_crc32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = decode_words(np.frombuffer(row["words"], "<u8"), lengths, np.array(row["offsets"], np.int64)).astype("<u4")
                first = np.cumsum(lengths) - lengths
                each = [ids[a : a + n] for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]
                values = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array(
                    [x.astype(np.int32) for x in each], pa.list_(pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(first),
                        pa.array(lengths),
                        values,
                        pa.array([row["shard"]] * len(each), pa.int32()),
                        pa.array([row["block"]] * len(each), pa.int32()),
                    ],
                    ["doc_id", "first", "n_tokens", name, "shard", "block"],
                )

    #: The words are decoded where they are read; only what is decoded meets the starts.
    decoded = blocks.mapInArrow(run, f"doc_id long, first long, n_tokens long, {column}, shard int, block int")
    return decoded.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("block_start")).alias("start"), "n_tokens", name
    )


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark)}/token_files_{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder, tokenizer_path)
    return token_digests(spark, folder)


QUERIES = {"op6_token_files": query}
