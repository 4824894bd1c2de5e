import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import decontamination as dc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=20), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_longest_common(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert dc.longest_common(x, y) == table[-1][-1]


def corpus(seed=9):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is", "a", "that"]
    rare = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rare() for _ in range(n)]
    items = {i: text(rng.randint(15, 60)) for i in range(30)} | {99: text(150)}
    rows, leaks = [], set()
    for d in range(200):
        words = text(rng.randint(5, 300))
        if d % 4 == 0:
            i = rng.choice(list(items))
            passage = list(items[i])
            if d % 8 == 0:  # a paraphrase: words replaced, the answer kept
                for k in rng.sample(range(len(passage) * 3 // 4), len(passage) // 6):
                    passage[k] = rare()
            at = rng.randint(0, len(words))
            words[at:at] = [w.capitalize() if rng.random() < 0.1 else w for w in passage]
            leaks.add((d, i))
        rows.append((d, " ".join(words) + "."))
    return rows, [(i, " ".join(w)) for i, w in items.items()], leaks


def test_finds_planted_passages_and_nothing_else(spark, docs):
    rows, items, leaks = corpus()
    bench = spark.createDataFrame([*items, (500, None), (501, ""), (502, "...")], "item_id long, text string")
    rows += [(1000, None), (1001, ""), (1002, "the of and to in is a that " * 40)]
    for size in (dc.BLOCK_BYTES, 3000):
        got = dc.contaminated(docs(rows), bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == leaks and len(got) == len(leaks)


def test_recall_of_the_latent_search(spark, docs):
    """Candidates by latent cosine against all windows by plain cosine of the same vectors."""
    rows, items, _ = corpus(4)
    limits = dc.Limits()
    terms = dc.Terms([s for i, t in items for s in dc.segments_of(i, t.encode())])
    found = dc.indexed(docs(rows), terms)
    terms.weigh(dc.term_frequencies(found, terms), len(rows))
    basis = dc.latent_basis(found, terms, limits, 128)
    hits = total = 0
    queries = np.zeros((len(terms.segments), len(terms.number)))
    for q, (t, w) in zip(queries, terms.vectors()):
        q[t] = w
    latent = queries @ basis[:-1]
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    for _, text in rows:
        words = dc.words_of(text.encode())
        for a, b in zip(*dc.windows_of(len(words))):
            tf = np.bincount(terms.indices(words[a:b]).astype(int), minlength=len(terms.idf))
            x = (np.sqrt(tf) * terms.idf / np.sqrt(np.sum(tf * terms.idf**2)))[:-1]
            plain = queries @ x >= 0.5
            total += plain.sum()
            hits += (plain & (latent @ (x @ basis[:-1]) >= limits.cosine)).sum()
    assert total > 50 and hits >= 0.9 * total


def test_window_vectors_equal_plain_ones(docs):
    rows, items, _ = corpus(5)
    limits = dc.Limits()
    terms = dc.Terms([s for i, t in items for s in dc.segments_of(i, t.encode())])
    rows += [(300, " ".join(["the", "of"] * 9)), (301, items[0][1].split()[0]), (302, "zz " * 50)]
    texts = {i: dc.words_of(t.encode()) for i, t in rows}
    table = dc.indexed(docs(rows), terms).toArrow()
    seen = 0
    for p, part in dc.passages(iter(table.combine_chunks().to_batches()), terms, limits):
        ids = part.column("doc_id").to_pylist()
        vectors = {}
        for found, term, weight in p.vectors(terms):
            for r, t, w in zip(found, term, weight):
                vectors[
                    ids[p.document[r]], int(p.start[r] - p.first[p.document[r]]), int(p.end[r] - p.start[r])
                ] = np.bincount(t, w, len(terms.idf))[:-1]
        seen += len(vectors)
        for i in ids:
            for a, b in zip(*dc.windows_of(len(texts[i]))):
                tf = np.bincount(terms.indices(texts[i][a:b]).astype(int), minlength=len(terms.idf))
                norm = np.sum(tf * terms.idf**2)
                share = np.sum((tf * terms.idf**2)[:-1]) / norm
                if share > limits.cosine**2 + 1e-9:
                    assert np.allclose(vectors[i, a, b - a], (np.sqrt(tf) * terms.idf / np.sqrt(norm))[:-1], atol=1e-6)
    assert seen > 100


def test_empty_and_clashing(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert dc.contaminated(docs([]), bench).count() == 0
    assert dc.contaminated(docs([(1, "x y")]), bench.limit(0)).count() == 0
    df = spark.createDataFrame(
        [
            (1, "so alpha beta gamma delta epsilon zeta eta theta iota kappa on", 1),
            (1, "so alpha beta gamma delta epsilon zeta eta theta iota kappa on", 1),
            (2, "fine", 2),
            (None, None, 3),
        ],
        "doc_id long, text string, item_id int",
    )
    assert [(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()] == [(1, 1)]
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]

def planted(n_items, copies, change=0.0, seed=31):
    """Benchmark items in prose of many words, each put into a host of its own, and the hosts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(6000)]
    weights = [1 / (i + 3) for i in range(len(vocabulary))]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = {i: text(rng.randint(18, 60)) for i in range(n_items)}
    rows = []
    for i in range(copies):
        passage = list(items[i])
        for k in rng.sample(range(len(passage)), round(len(passage) * change)):
            passage[k] = f"zz{rng.randrange(10**9)}"
        host = text(rng.randint(20, 200))
        at = rng.randint(0, len(host))
        rows.append((i, " ".join(host[:at] + passage + host[at:])))
    rows += [(10**6 + i, " ".join(text(150))) for i in range(copies)]
    return rows, [(i, " ".join(w)) for i, w in items.items()]


def test_every_exact_copy_of_many_more_items_than_the_rank(spark, docs):
    rows, items = planted(2000, 300)
    assert len(items) > 10 * dc.RANK
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(300)}


def test_weights_and_edited_copies_do_not_depend_on_the_size_of_the_corpus(spark, docs, monkeypatch):
    terms = dc.Terms(dc.segments_of(1, b"alpha beta gamma delta"))
    share = np.array([1, 20, 500, 9000])
    terms.weigh(share * 10, 100_000)
    small = terms.idf
    terms.weigh(share * 3000, 30_000_000)
    assert np.allclose(small, terms.idf, atol=0.1) and terms.idf[-1] == small[-1] == terms.idf.max()
    rows, items = planted(200, 200, 0.2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    weigh = dc.Terms.weigh
    for times in (1, 3000):
        monkeypatch.setattr(dc.Terms, "weigh", lambda self, frequency, total, times=times: weigh(self, frequency * times, total * times))
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), bench).collect()}
        assert got <= {(i, i) for i in range(200)} and len(got) >= 198


def test_answers_equal_plain_cosine_and_subsequence(spark, docs):
    """The whole answer, worked out plainly for a benchmark of fewer terms than the rank: there the latent space holds every vector."""
    rng = random.Random(21)
    filler = [f"f{i}" for i in range(40)]
    own = [f"q{i}" for i in range(70)]
    items = [(i, " ".join(rng.choice(own) for _ in range(rng.randint(12, 30)))) for i in range(6)] + [(9, "where is q1 q2 ? q3 q4 q5")]
    rows = []
    for d in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 120))]
        for _ in range(d % 3):
            passage = rng.choice(items)[1].split()
            for k in rng.sample(range(len(passage)), rng.randint(0, len(passage) // 2)):
                passage[k] = rng.choice(own + filler)
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((d, " ".join(words)))
    limits = dc.Limits()
    segments = [s for i, t in items for s in dc.segments_of(i, t.encode())]
    terms = {w for s in segments for w in s.words}
    texts = {d: dc.words_of(t.encode()) for d, t in rows}
    df = {w: sum(w in t for t in texts.values()) for w in terms}
    idf = lambda w: 1 + min(np.log(dc.RAREST), np.log((len(rows) + 1) / (df.get(w, 0) + 1)))

    def cosine(window, segment):
        norm = sum(idf(w) ** 2 for w in window)
        held, sought = ({w: np.sqrt(x.count(w)) * idf(w) for w in set(x) & terms} for x in (window, segment))
        length = np.sqrt(sum(v * v for v in held.values()))
        if length * length < limits.cosine**2 * norm:
            return 0.0
        return sum(v * held.get(w, 0) for w, v in sought.items()) / np.sqrt(norm * sum(v * v for v in sought.values()))

    def shares(near, s):
        return dc.longest_common(s.words, near) / len(s.words), dc.longest_common(s.answer, near) / len(s.answer)

    taken = lambda common, answered: common >= limits.common and (common >= limits.certain or answered >= limits.answer)
    expected = {}
    for d, words in texts.items():
        if not terms & set(words):
            continue
        for s in segments:
            found = []
            for a, b in zip(*dc.windows_of(len(words))):
                if cosine(words[a:b], s.words) >= limits.cosine:
                    found.append(shares(words[max(0, a - dc.MARGIN) : b + dc.MARGIN], s))
            found = [x for x in found if taken(*x)]
            if not found:
                blocks = -(-(len(s.words) + max(8, len(s.words) // 2)) // dc.BLOCK) + 1
                for a in range(0, len(words), dc.BLOCK):
                    near = words[a : a + blocks * dc.BLOCK]
                    weight = sum(min(near.count(w), s.words.count(w)) * idf(w) ** 2 for w in set(s.words))
                    if weight >= limits.common * sum(idf(w) ** 2 for w in s.words):
                        found += [x for x in [shares(near, s)] if taken(*x)]
            for common, answered in found:
                best = expected.get((d, s.item_id), (0, 0))
                expected[d, s.item_id] = max(best[0], common), max(best[1], answered)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.common_share, r.answer_share) for r in dc.contaminated(docs(rows), bench).collect()}
    assert len(expected) > 20 and set(got) == set(expected)
    assert all(np.allclose(got[k], expected[k]) for k in expected)


@pytest.mark.parametrize("items,change", [(2000, 0.3)])
def test_recall_of_edited_copies_beyond_the_rank(spark, docs, items, change):
    rows, bench = planted(items, 200, change)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got <= {(i, i) for i in range(200)} and len(got) >= 0.9 * 200


def test_blocks_of_a_benchmark_read_the_texts_once(spark, docs, monkeypatch):
    """One pass over the texts for many blocks, numbers as each block's own index has them."""
    rows, items, _ = corpus(8)
    rows = rows[:40]
    bench = spark.createDataFrame(items, "item_id long, text string")
    calls = []
    index = dc.indexed
    monkeypatch.setattr(dc, "indexed", lambda d, t: calls.append(t) or index(d, t))
    dc.contaminated(docs(rows), bench, block_bytes=4000).collect()
    assert len(calls) == 1 and type(calls[0]) is dc.Vocabulary
    every = dc.benchmark_words(bench)
    for part in (items[:5], items[9:10], items):
        terms = dc.Terms([s for i, t in part for s in dc.segments_of(i, t.encode())])
        want = {r.doc_id: r.terms for r in index(docs(rows), terms).collect()}
        assert {r.doc_id: r.terms for r in dc.renumbered(index(docs(rows), every), every, terms).collect()} == want
