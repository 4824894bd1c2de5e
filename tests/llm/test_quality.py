import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import quality


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "É", " ", "🙂x", " ", " ", "\n", "\t", "#", "<b>", "the"]), max_size=60).map("".join))
def test_counts_equal_plain_ones(text):
    base, classes, common = quality.measure(text.encode(), {b"a": 0, b"the": 1})
    assert base == plain(text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    held = [words.count("a"), words.count("the")]
    share = [n * quality.UNIT // max(1, len(words)) for n in (*held, len(words) - sum(held))]
    assert len(classes) == len(quality.CLASSES) and common == share


def test_distance_bounds():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    found = quality.jensen_shannon(p, np.array([[0.0, 1.0], [0.5, 0.5]]))
    assert abs(found[0, 0] - 1) < 1e-12 and found[1, 1] < 1e-6


def test_verdicts(docs):
    clean = " ".join(f"the word{i} of a day{i % 7}{i} and so" for i in range(60))
    junk = "".join(f"@{i}~^~^~{i * 7}~~ " for i in range(300))
    rows = [(i, clean + str(i), "en") for i in range(20)]
    rows += [
        (50, junk, None),
        (51, None, "en"),
        (52, "", "fr"),
        (53, "few words", "en"),
        (54, "same old song " * 60, "en"),
        (54, "same old song " * 60, "en"),
        (None, clean, "en"),
    ]
    got = quality.quality_rules(docs(rows)).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert verdict[3] == verdict[None] == (False, True) and verdict[50] == (False, False)
    assert all(verdict[i] == (True, False) for i in (51, 52, 53, 54))
    assert quality.quality_rules(docs([])).count() == 0


def test_no_language_column(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = quality.quality_rules(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, kept string")).collect()
    assert rows[0].kept is True


def test_labelled_junk_goes_and_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = quality.query(spark, folder).join(labels, "doc_id").where("NOT base_failed").collect()
    good, junk = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and sum(good) >= 0.97 * len(good)
    assert len(junk) > 10 and sum(junk) <= 0.3 * len(junk)


WORDS = {"en": "the of and to in a is that it on for was with be as by", "de": "der die und in den von zu das mit sich des auf für ist"}


def sample(rng, lang):
    return " ".join(
        rng.choice(WORDS[lang].split()) if rng.random() < 0.5 else f"w{rng.randrange(5000)}" for _ in range(rng.randint(90, 160))
    )


def test_distance_is_to_the_own_language(docs):
    rng = random.Random(4)
    rows = [(i, sample(rng, lang), lang) for lang, a in (("en", 0), ("de", 100)) for i in range(a, a + 30)]
    rows.append((999, rows[40][1], "en"))
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs(rows)).collect()}
    assert not got.pop(999) and all(got.values())


def distance(p, q):
    middle = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, middle) if a > 0)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances_and_verdicts_equal_plain_ones(docs, monkeypatch):
    """Common words, references, limits, distances and kept, worked out anew from the definitions."""
    rng = random.Random(11)
    rows = [(i, sample(rng, lang), lang) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [
        (100, " ".join(f"x{i} |" for i in range(120)), "en"),
        (101, sample(rng, "de").upper(), "de"),
        (102, "1 2 3 ; # $ " * 60, "en"),
        (103, sample(rng, "en"), None),
        (104, None, "en"),
    ]
    rows += [(105, " ".join(f"z{i} of" for i in range(70)), "xx"), (106, "  der  die\n" * 30 + sample(rng, "de"), "de")]
    monkeypatch.setattr(quality, "COUNTED_BYTES", 2000)
    limits = quality.Limits()
    got = {r.doc_id: r for r in quality.quality_rules(docs(rows)).collect()}

    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for i, t, _ in rows}
    low = {i: [w.lower() if w.isascii() else w for w in ws] for i, ws in words.items()}
    common = set()
    for lang in {g for _, _, g in rows if g}:
        counts = Counter(w for i, _, g in rows if g == lang for w in low[i])
        common |= {w for w, n in counts.items() if n * quality.COMMON >= counts.total()}
    order = sorted(common)

    def shares(counts):
        whole = [n * quality.UNIT // max(1, sum(counts)) for n in counts]
        return [n / max(1, sum(whole)) for n in whole], whole

    hists = {}
    for i, t, _ in rows:
        by_word = [low[i].count(w) for w in order]
        by_class = [sum(quality.class_of(c) == k for c in t or "") for k in range(len(quality.CLASSES))]
        hists[i] = shares(by_class), shares([*by_word, len(words[i]) - sum(by_word)])
    chars = {i: sum(map(len, words[i])) for i in words}
    judged = {i: (chars[i] >= limits.min_chars, len(words[i]) >= limits.min_words) for i in words}
    far, found = {i: False for i in words}, {i: [None, None] for i in words}
    for kind, most, spreads in ((0, limits.class_distance, limits.class_spreads), (1, limits.word_distance, limits.word_spreads)):
        reference, limit = {}, {}
        for lang in sorted({g for i, _, g in rows if g and judged[i][kind]}):
            own = [i for i, _, g in rows if g == lang and judged[i][kind]]
            sums = [sum(x) for x in zip(*(hists[i][kind][1] for i in own))]
            reference[lang] = [x / sum(sums) for x in sums]
            steps = sorted(round(distance(hists[i][kind][0], reference[lang]) * quality.STEPS) for i in own)
            half, upper = (steps[math.ceil(q * len(steps)) - 1] / quality.STEPS for q in (0.5, 0.75))
            limit[lang] = min(most, half + spreads * max(limits.least_spread, upper - half))
        for i, _, g in rows:
            if judged[i][kind]:
                by = {lang: distance(hists[i][kind][0], r) for lang, r in reference.items()}
                found[i][kind] = by[g] if g in by else min(by.values())
                far[i] |= by[g] > limit[g] if g in by else all(by[x] > limit[x] for x in by)
    for i, _, _ in rows:
        base = plain(dict((a, b) for a, b, _ in rows)[i] or "")
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert [got[i][c] for c in quality.COUNTS] == base and got[i].base_failed == failed
        for a, b in zip((got[i].class_distance, got[i].word_distance), found[i]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-7)
        assert got[i].kept == (not failed and not far[i]), i
    assert not got[100].kept and got[3].kept


def test_memory_with_many_languages(tmp_path):
    """A hundred languages with their own words: a batch of 10,000 rows is judged in far less than 2 GB."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from paperlake.llm import quality
languages, bins, rows = 100, 10_000, 10_000
rng = np.random.default_rng(0)
reference = rng.random((languages, bins))
known = {{"common": ([str(k) for k in range(languages)], reference / reference.sum(axis=1, keepdims=True))}}
at = pa.array([np.sort(rng.choice(bins, 50, replace=False)).astype(np.int32) for _ in range(rows)], pa.list_(pa.int32()))
share = pa.array([np.full(50, 20_000, np.int32)] * rows, pa.list_(pa.int32()))
batch = pa.RecordBatch.from_arrays([pa.array([str(k % 101) for k in range(rows)]), at, share], ["lang", "common_at", "common"])
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
seen = 0
for part in quality.pieces(iter([batch]), known):
    own = quality.places(part, known["common"][0])
    far, _ = quality.judged_by(quality.matrix_of(part, "common", known["common"][1]), known["common"][1], np.full(languages, 0.5), own)
    seen += len(far)
assert seen == rows
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) >> 10)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", code.format(root=root)], capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) < 500
