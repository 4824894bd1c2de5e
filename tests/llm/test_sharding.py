import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from paperlake.llm import sharding


def least_capacity(sizes, shards):
    """By dynamic programming over all cuts."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        nxt = list(best)
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j - 1, -1, -1):
                total += sizes[i]
                nxt[j] = min(nxt[j], max(best[i], total))
        best = nxt
    return best[-1]


def test_capacity_is_the_smallest_and_cuts_keep_it(spark):
    rng = random.Random(2)
    for shards in (1, 2, 5, 9):
        cases = [[rng.choice([1, 5, 9, 100, 16, 40]) for _ in range(rng.randint(1, 30))] for _ in range(15)] + [
            [7], [3, 1000, 2, 2], [1000, 1, 1, 1, 1, 1, 1, 1, 1]
        ]
        df = spark.createDataFrame([(c,) for c in cases], "sizes array<bigint>")
        for r in sharding.with_cuts(df, shards).collect():
            assert r.capacity == least_capacity(r.sizes, shards)
            edges = [0, *r.cuts, len(r.sizes)]
            assert edges == sorted(set(edges)) and len(r.cuts) < shards
            assert max(sum(r.sizes[a:b]) for a, b in zip(edges, edges[1:])) <= r.capacity
    one = sharding.with_cuts(spark.createDataFrame([([1000, *[1] * 40],)], "sizes array<bigint>"), 5).first()
    assert len(one.cuts) == 4


def test_rows(docs):
    rng = random.Random(4)
    rows = [(i, "text é " * rng.randint(0, 30) + str(rng.randint(0, 150))) for i in range(400)]
    rows += [(1000 + i, "the same text") for i in range(200)] + [(2000, None), (2001, ""), (None, "x"), (1, rows[1][1])]
    got = sharding.shard_documents(docs(rows), 7).collect()
    assert len(got) == len(rows)
    by_text, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    text_of = {(i, zlib.crc32((t or "").encode())): t for i, t in rows}
    for r in got:
        t = text_of[r.doc_id, r.text_crc32]
        assert r.size == len((t or "").encode()) + 16 and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(7)) and max(sizes.values()) < 2 * sum(sizes.values()) / 7


def test_large_atom_spreads_over_runs(docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 10)
    got = sharding.shard_documents(docs([(i, "same") for i in range(95)] + [(200, "other")]), 3)
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_and_clashing_columns(spark, docs):
    assert sharding.shard_documents(docs([]), 4).count() == 0
    df = spark.createDataFrame([(1, "a", 3, 4)], "doc_id long, text string, size int, shard int")
    assert sharding.shard_documents(df, 4).select("size", "shard").first() == (17, 0)


def test_no_python_in_the_plan(docs, capsys):
    sharding.shard_documents(docs([(1, "a")]).where(F.lit(True)), 4).explain()
    assert "Python" not in capsys.readouterr().out


def test_many_atoms_in_near_equal_shards(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string").cast("binary")), 3).alias("text")
    )
    sizes = [r.b for r in sharding.shard_documents(df, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.05 * sum(sizes) / 40
