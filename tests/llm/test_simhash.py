import random

import numpy as np
import xxhash

from paperlake.llm import simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in fps:
        for y in fps:
            if x < y and (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    return {x: find(x) for x in fps}


def expected(rows):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components({f for _, f in fp})
    low = {}
    for i, f in fp:
        if i is not None:
            low[comp[f]] = min(i, low.get(comp[f], i))
    return sorted(((i, f"{f:016x}", low.get(comp[f])) for i, f in fp), key=str)


def test_matches_brute_force(docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "ONE two"), (6, "École école"), (7, "x y z")]
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 200))
        for k in range(4):
            words = list(base)
            for _ in range(k):
                words[rng.randrange(len(words))] = "new"
            rows.append((100 + 4 * i + k, " ".join(words)))
    rows += rows[:6] + [(None, "a b c d"), (90, "a b c d")]
    found = [tuple(r) for r in simhash.simhash_groups(docs(rows)).collect()]
    assert sorted(found, key=str) == expected(rows)


def test_links_span_dense_cells(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    near = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (120, 2))}
    chain = [(1 << k) - 1 for k in range(0, 64, 3)]
    fps = sorted(near | set(chain))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    for tile in (4096, 16):
        links = simhash.fingerprint_links(df, tile=tile).collect()
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = a % 2**64, b % 2**64
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        want = plain_components(fps)
        groups = lambda f: sorted(map(sorted, __import__("collections").defaultdict(list, {}).values())) if not f else sorted(sorted(x for x in fps if f(x) == r) for r in {f(x) for x in fps})
        assert groups(find) == groups(want.get)


def test_empty_and_clashing_columns(spark, docs):
    assert simhash.simhash_groups(docs([])).collect() == []
    df = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "a b c d", 8, "y")], "doc_id long, text string, fp long, component_id string")
    assert sorted(map(tuple, simhash.simhash_groups(df).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
