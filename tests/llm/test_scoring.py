import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from paperlake.llm import scoring


def plain(rows, priors):
    """Counts, then every text walked token by token over states and failure arcs kept as plain tables."""

    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return ["<start>", *re.findall(r"[^\x20\x09-\x0D]+", low), None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count, context = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = tokens(t)
            for k in (1, 2, 3):
                for i in range(1 if k == 1 else 0, len(w) - k + 1):
                    count[tuple(w[i : i + k])] += 1
            context.update((x,) for x in w[:-1])
    ones = {g[0]: c for g, c in count.items() if len(g) == 1}
    n, v = sum(ones.values()), len(ones)
    context.update({g: c for g, c in count.items() if len(g) == 2})

    def probability(gram):
        lower = (ones.get(gram[0], 0) + 0.5) / (n + 0.5 * (v + 1)) if len(gram) == 1 else probability(gram[1:])
        if len(gram) == 1:
            return lower
        prior = priors[len(gram) - 2]
        return (count[gram] + prior * lower) / (context[gram[:-1]] + prior)

    out = []
    for (i, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10(probability((x,))) for x in w[1:])
        state, score = ("<start>",), 0.0
        for x in w[1:]:
            while state and count[(*state, x)] == 0:
                prior = priors[len(state) - 1]
                score += math.log10(prior / (context[state] + prior))
                state = state[1:]
            score += math.log10(probability((*state, x)))
            state = (*state, x)[-2:]
            while state and not context[state]:
                state = state[1:]
        direct = sum(math.log10(probability(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w)))
        assert abs(direct - score) < 1e-6 * max(1, abs(direct))
        out.append((i, h, len(w) - 1, sum(x in ones for x in w[1:]), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()),
        key=str,
    )


def test_matches_brute_force(docs):
    rng = random.Random(6)
    words = ["The", "the", "of", "É", "é", "cat", "<s>", "</s>", "a-b", "sat.", " x"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "\n", " \t"])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "long " * 5000), (None, "the cat"), (7, rows[7][1]), (7, "other text")]
    for size in (1 << 20, 600):
        assert rows_of(scoring.score_documents(docs(rows), block_bytes=size)) == plain(rows, (scoring.PAIR_PRIOR, scoring.TRIPLE_PRIOR))


def test_probabilities_sum_to_one():
    """From the state of a pair, over all words, an unseen one and the end."""
    ends = ["a", "b", "c", "zzz", ""]
    texts = pa.array(["a b a c", "b b a", *(f"b a {x}" for x in ends)])
    block = scoring.Block(texts)
    counts = block.counts(np.array([True, True] + [False] * len(ends)))
    machine = scoring.Automaton(block, counts, 2, int(counts[1].sum()), int((counts[1] > 0).sum()), (3.0, 2.0))
    last = block.first[2:] + block.lengths[2:] - 1
    third = [log_probability_of_third(machine, block, int(i)) for i in last]
    assert abs(sum(10**x for x in third) - 1) < 1e-9


def log_probability_of_third(machine, block, end):
    """Log10 probability of the third token of a text ``b a x``, from its weights along the failure arcs."""
    i = end if block.lengths[np.searchsorted(block.first, end, side="right") - 1] == 3 else end - 1
    later = np.flatnonzero(block.later)
    t = machine.triple[block.of[3][np.searchsorted(later, i)]]
    if t <= 0:
        return t
    total = machine.pair_failure[block.of[2][i - 1]]
    p = machine.pair[block.of[2][i]]
    if p <= 0:
        return total + p
    return total + machine.word_failure[block.of[1][i - 1]] + machine.root[block.of[1][i]]


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for high in (0, 1, 255, 256, 2**40, 2**64 - 1):
        x = rng.integers(0, high, 1000, np.uint64, endpoint=True)
        assert (scoring.unpacked(scoring.packed(x)) == x).all()
    assert len(scoring.unpacked(scoring.packed(np.zeros(0, np.int64)))) == 0


def test_better_than_the_base_on_held_out(docs):
    rng = random.Random(8)
    chain = {i: [rng.randrange(30) for _ in range(2)] for i in range(30)}

    def text():
        x, out = 0, []
        for _ in range(300):
            x = rng.choice(chain[x])
            out.append(f"w{x}")
        return " ".join(out)

    got = scoring.score_documents(docs([(i, text()) for i in range(120)])).where("held_out").collect()
    assert len(got) > 5 and all(r.score > r.base_score for r in got)


def test_empty_and_clashing(spark, docs):
    assert scoring.score_documents(docs([])).count() == 0
    df = spark.createDataFrame([(1, "a b", 3, 4), (6, None, 3, 4)], "doc_id long, text string, block int, training int")
    assert scoring.score_documents(df).count() == 2


def test_the_blocks_are_removed(spark, docs, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    rows = scoring.score_documents(docs([(i, f"a b c {i}") for i in range(30)]))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert {t.name for t in spark.catalog.listTables()} <= before and not [f for f in os.listdir(folder) if f.startswith("blocks_")]
    assert rows.count() == 30
