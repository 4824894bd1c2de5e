"""Papers of similar content: by vectors, and by weighted terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import tokens


def by_vector(vectors: DataFrame, seed_id: int, limit: int = 10) -> DataFrame:
    """vectors(id, vector): the nearest by cosine to the seed, which is not among them."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    #: One row by key; without it nothing is similar.
    seed = F.broadcast(vectors.where(F.col("id") == seed_id).limit(1).select(F.col("vector").alias("seed")))
    cosine = dot(F.col("vector"), F.col("seed")) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("seed"), F.col("seed")))
    scored = vectors.where(F.col("id") != seed_id).crossJoin(seed).select("id", F.round(cosine, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


#: Distinct terms of a seed up to which they are sent to every task.
SENT_TERMS = 100_000


def by_terms(docs: DataFrame, seed_id: int, limit: int = 10) -> DataFrame:
    """docs(id, text): sum over shared terms of (1 + ln tf) idf^2, idf = ln(N / df) over all documents.

    All documents meet the seed's distinct terms before anything is shuffled, so that only shared
    terms are counted and moved. The terms of one document are broadcast where they are few enough
    (counted first), else joined by term.
    """
    own = docs.where(F.col("id") == seed_id).select(F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct()
    seed = F.broadcast(own) if own.count() <= SENT_TERMS else own
    shared = docs.select(
        "id", F.explode(tokens("text")).alias("term")
    ).join(seed, "term").groupBy("id", "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n"))
    weights = shared.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select(
        "term", F.log(F.col("n") / F.col("df")).alias("idf")
    )
    scored = shared.where(F.col("id") != seed_id).join(weights, "term")
    scores = scored.groupBy("id").agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf") * F.col("idf")), 6).alias("score"))
    return scores.orderBy(F.desc("score"), "id").limit(limit)
