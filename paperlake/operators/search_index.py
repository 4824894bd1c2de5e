"""A kept inverted index over documentation chunks, and ranked search that skips blocks of it.

``build`` cleans and cuts every chunk once. Its tables: ``chunks`` (cleaned, numbered, in index order), ``words`` (the
vocabulary), ``maxima`` (the most that a word counts in any chunk of a block, sorted by word) and ``postings``
(the chunks of a block that hold a word, with weights and hits, by block). A block lies in one task, which gathers its
postings, so of all that is built only texts (once, into their order), distinct words and maxima move. A query meets the
words that contain its terms, bounds every block by their maxima, scores the best blocks first, and reads further ones
only where they can still reach the worst score that made the list. Texts are read for the rows that are returned, and for
those that may hold the whole phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as T
from paperlake.operators import search
from paperlake.storage import remove_folder

#: Chunks in a block, and rows of a sorted range of chunks, about.
BLOCK_BITS = 9
RANGE_ROWS = 50_000
#: What a word counts in each field: the field's own weight and one for the text of all fields.
WEIGHTS = {"title": 5, "section": 4, "subsection": 3, "doc_type": 1, "category": 1, "content": 1}
#: Words with repeats that a task holds before it writes the postings of what it has of a block.
HELD_WORDS = 4_000_000
#: Blocks that are scored first, and the most words, blocks and chunks that a filter lists; beyond it they are joined.
FIRST_BLOCKS = 32
LISTED_WORDS, LISTED = 200, 1000
#: Values up to which a filter is a chain of equalities, each of which a sorted file's pages are compared with.
CHAINED = 200


def build(cleaned: DataFrame, folder: str) -> None:
    """Write the index of ``search.clean_chunks`` rows."""
    spark = cleaned.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(session, -(-cleaned.count() // RANGE_ROWS))
    ordered = cleaned.repartitionByRange(ranges, "ordinal").sortWithinPartitions("ordinal")
    doc = F.monotonically_increasing_id()
    ordered.withColumn("doc", doc).withColumn("block", F.shiftright("doc", BLOCK_BITS)).write.parquet(f"{folder}/chunks")

    chunks = spark.read.parquet(f"{folder}/chunks")
    words = [T.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in WEIGHTS]
    chunks.select("doc", "block", *words).mapInArrow(gather_postings, POSTINGS).write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    postings.groupBy("word").agg(F.count("*").alias("blocks")).write.parquet(f"{folder}/words")
    sizes = postings.select("word", "block", "top_weight", "top_hits")
    sizes.repartitionByRange("word", "block").sortWithinPartitions("word", "block").write.parquet(f"{folder}/maxima")


POSTINGS = "block long, word string, top_weight long, top_hits long, docs array<struct<doc:long,weight:long,hits:long>>"


def postings_of(block: int, docs: np.ndarray, words: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
    """The postings of a block from its words as they come: a row a word, with its chunks in order."""
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known, place = np.unique(docs, return_inverse=True)
    pair, of, hits = np.unique(code * len(known) + place, return_inverse=True, return_counts=True)
    weight = np.bincount(of, weights, len(pair)).astype(np.int64)
    word, doc = pair // max(1, len(known)), known[pair % max(1, len(known))]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    listed = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (doc, weight, hits)], ["doc", "weight", "hits"])
    columns = [
        pa.array(np.full(len(starts), block), pa.int64()), vocabulary.take(pa.array(word[starts])), pa.array(np.maximum.reduceat(weight, starts)),
        pa.array(np.maximum.reduceat(hits, starts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(pair)].astype(np.int32)), listed),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "word", "top_weight", "top_hits", "docs"])


def gather_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (doc, block, words of each field), in order, to the postings of their blocks.

    A block of very long texts, and one that two tasks read, has its words in more than one row: their lists add up,
    and so do their maxima, to a bound that is higher than it need be.
    """
    block, held, n = None, [], 0

    def gathered() -> pa.RecordBatch:
        docs, words, weights = zip(*held)
        return postings_of(block, np.concatenate(docs), pa.concat_arrays(words), np.concatenate(weights))

    for batch in batches:
        doc, of_block = (batch.column(c).to_numpy() for c in ("doc", "block"))
        cuts = np.flatnonzero(np.r_[True, of_block[1:] != of_block[:-1]]) if len(of_block) else []
        for start, end in zip(cuts, [*cuts[1:], len(of_block)]):
            if held and (of_block[start] != block or n >= HELD_WORDS):
                yield gathered()
                held, n = [], 0
            block = int(of_block[start])
            for name, weight in WEIGHTS.items():
                lists = batch.column(name).slice(start, end - start)
                words = lists.flatten().cast(pa.string())
                if len(words):
                    held.append((np.repeat(doc[start:end], pc.list_value_length(lists).to_numpy()), words, np.full(len(words), weight)))
                    n += len(words)
    if held:
        yield gathered()


def any_of(column: str, values: list) -> Column:
    """One of these values."""
    if len(values) > CHAINED:
        return F.col(column).isin(values)
    parts = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(parts) > 1:  # a balanced tree, not a deep one
        parts = [a | b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


class Index:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.chunks, self.words, self.maxima, self.postings = (spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "words", "maxima", "postings"))
        #: All blocks of a small index, which needs no bounds; of a larger one more than are scored first.
        self.first = FIRST_BLOCKS
        self.blocks = [r.block for r in self.chunks.select("block").distinct().limit(self.first + 1).collect()]

    def search(self, query: str, limit: int = 5) -> DataFrame:
        """The rows of ``search.search`` over the same chunks."""
        phrase, limit = query.strip().lower(), max(1, int(limit))
        terms = Counter(search.query_terms(phrase))
        if not terms:  # punctuation alone is in no word
            return search.search(self.chunks.drop("doc", "block"), query, limit)
        matched = self._matched(terms)
        whole = len(terms) == 1 and phrase in terms
        found = self._candidates(matched, terms, limit, whole)
        if isinstance(found, list):
            kept = self.chunks.where(any_of("block", sorted({r.block for r in found})) & F.col("doc").isin([r.doc for r in found]))
            scores = F.create_map(*(F.lit(x) for r in found for x in (r.doc, r.score))) if found else F.create_map().cast("map<bigint,bigint>")
            kept = kept.withColumn("score", F.element_at(scores, F.col("doc")))
        else:
            kept = self.chunks.join(found.select("doc", "score"), "doc")
        if not whole:
            text = lambda c: F.coalesce(F.col(c), F.lit(""))
            every = F.lower(F.concat_ws(" ", *(text(c) for c in WEIGHTS)))
            kept = T.worked_out(kept.withColumn("score", F.col("score") + 6 * T.occurrences(every, phrase)))
        top = kept.orderBy(F.desc("score"), F.desc("char_count"), F.asc("ordinal")).limit(limit)
        return top.drop("doc", "block").withColumn("snippet", T.snippet(F.col("content"), list(terms)))

    def _matched(self, terms: Counter) -> DataFrame:
        """The words that contain a term: word, times (for the score) and in_0, in_1, ... (for each term)."""
        return self._meeting(self.words, terms).drop("blocks")

    def _meeting(self, rows: DataFrame, terms: Counter) -> DataFrame:
        """The rows whose word contains a term, with times and in_0, in_1, ...: told from the word itself, so nothing is joined."""
        holds = F.lit(False)
        for t in terms:
            holds = holds | F.contains("word", F.lit(t))
        within = {f"in_{i}": T.occurrences(F.col("word"), t) for i, t in enumerate(terms)}
        times = sum((n * repeats for n, repeats in zip(within.values(), terms.values())), F.lit(0))
        return rows.where(holds).withColumns({"times": times, **within})

    def _candidates(self, matched: DataFrame, terms: Counter, limit: int, exact: bool) -> list[Row] | DataFrame:
        """doc, block, score (of the terms; with ``exact``, the phrase too) and bound (with the phrase at most) of all chunks that may be among the best.

        A list where they are at most ``LISTED``, else a table.
        """

        def scored(rows: DataFrame, by: list[str], weight: str, hits: str) -> DataFrame:
            sums = [F.sum(F.col(f"in_{i}") * F.col(hits)).alias(f"hits_{i}") for i in range(len(terms))]
            added = rows.groupBy(*by).agg(F.sum(F.col("times") * F.col(weight)).alias("terms"), *sums)
            fits = [F.expr(f"hits_{i} div {n}") for i, n in enumerate(terms.values())]
            bound = F.col("terms") + 6 * (F.least(*fits) if len(fits) > 1 else fits[0])
            return added.select(*by, (bound if exact else F.col("terms")).alias("score"), bound.alias("bound"))

        def of_blocks(rows: DataFrame) -> DataFrame:
            flat = self._meeting(rows, terms).select("block", "times", *(f"in_{i}" for i in range(len(terms))), F.inline("docs"))
            return scored(flat, ["block", "doc"], "weight", "hits")

        def best(rows: DataFrame) -> list[Row]:
            return rows.orderBy(F.desc("bound")).limit(LISTED + 1).collect()

        def least_of(listed: list[Row]) -> int:
            """A score that ``limit`` chunks reach, whatever phrases they hold."""
            return sorted((r.score for r in listed), reverse=True)[limit - 1] if len(listed) >= limit else 1

        def whole_list(listed: list[Row], least: int) -> list[Row] | None:
            """All that reach ``least``, if the list goes as far down."""
            open_ = [r for r in listed if r.bound >= least]
            return open_ if len(listed) <= LISTED or len(open_) < len(listed) else None

        if len(self.blocks) <= min(self.first, FIRST_BLOCKS):
            rows = of_blocks(self.postings)
            listed = best(rows)
            least = least_of(listed)
            found = whole_list(listed, least)
            return rows.where(F.col("bound") >= least) if found is None else found
        few = [r.word for r in matched.select("word").limit(LISTED_WORDS + 1).collect()]
        maxima = self.maxima.where(any_of("word", few)) if len(few) <= LISTED_WORDS else self.maxima
        bounds = scored(self._meeting(maxima, terms), ["block"], "top_weight", "top_hits").drop("score")
        blocks = best(bounds)
        early = [r.block for r in blocks[:FIRST_BLOCKS]]
        rows = of_blocks(self.postings.where(any_of("block", early)))
        listed = best(rows)
        least = least_of(listed)
        open_blocks = whole_list(blocks, least)
        if open_blocks is None:
            rows = of_blocks(self.postings.join(bounds.where(F.col("bound") >= least).select("block"), "block"))
            listed = best(rows)
        elif len(open_blocks) > len(early):
            rows = of_blocks(self.postings.where(any_of("block", [r.block for r in open_blocks])))
            listed = best(rows)
        least = max(least, least_of(listed))
        found = whole_list(listed, least)
        return rows.where(F.col("bound") >= least) if found is None else found
