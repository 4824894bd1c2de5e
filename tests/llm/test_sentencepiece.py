import numpy as np
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import sentencepiece_dropout as sd

PATH = sd.model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [
    "the ",
    "hello",
    " ",
    "  ",
    "\n",
    "é",
    "ciónes",
    "🙂",
    "日本",
    "\t",
    "tokenization",
    ".",
    "<s>",
    "<0x41>",
    "\x00",
    "A",
    "internationally" * 6,
]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)
WORDS = "tokenization of international correspondence "


def ids(text, key=1, rate=0.0):
    return sd.encode(text, PATH, key, rate).tolist()


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % 2**64
    return x ^ (x >> 31)


def plain_units(text):
    """The units of a text, by reading it character by character."""
    units = []
    for i, c in enumerate(text):
        before = text[i - 1] if i else "\n"
        if c in "\n▁" or before in "\n▁" or (c == " " and before != " "):
            units.append("")
        units[-1] += c
    return units


def plain(text, key, rate):
    """Merge dropout as written down: scan all neighbours for the best candidate that was not skipped."""
    known = {LIBRARY.id_to_piece(i): i for i in range(3, 32000) if not LIBRARY.is_byte(i)}
    byte = {int(LIBRARY.id_to_piece(i)[3:-1], 16): i for i in range(32000) if LIBRARY.is_byte(i)}
    out = []
    for number, unit in enumerate(plain_units(f" {text}" if text else "")):
        base = mixed((key + (number + 1) * 0x9E3779B97F4A7C15) % 2**64)
        parts = [(i, c) for i, c in enumerate(unit.replace(" ", "▁"))]
        skipped = set()
        while True:
            found = [(-LIBRARY.get_score(known[a + b]), i, j, k) for k, ((i, a), (j, b)) in enumerate(zip(parts, parts[1:])) if a + b in known and (i, j, a + b) not in skipped]
            if not found:
                break
            _, i, j, k = min(found)
            piece = parts[k][1] + parts[k + 1][1]
            draw = (xxhash.xxh64_intdigest(piece.encode()) + i * 0xD6E8FEB86659FD93) % 2**64
            if mixed(base ^ draw) < int(rate * 2**64):
                skipped.add((i, j, piece))
            else:
                parts[k : k + 2] = [(i, piece)]
        for _, p in parts:
            out += [known[p]] if p in known and unit != "▁" else [byte[b] for b in p.encode()]
    return out


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_without_dropout_equals_the_library(text):
    assert ids(text) == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from(PARTS[:-1] + ["▁", "      ", WORDS]), max_size=12).map("".join),
    st.integers(0, 2**64 - 1),
    st.sampled_from([0.1, 0.5, 0.9]),
)
def test_dropout_equals_a_plain_merge(text, key, rate):
    assert ids(text, key, rate) == plain(text, key, rate)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, st.text(max_size=60)), st.integers(0, 50), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
def test_round_trip(text, key, rate):
    raw = text.encode("utf-8", "ignore")
    text = raw.decode()
    assert sd.decode(np.array(ids(text, key, rate), np.uint32), PATH) == raw


def test_seeds_vary_and_library_decodes():
    text = WORDS * 40
    found = {tuple(ids(text, k, 0.2)) for k in range(5)}
    assert len(found) == 5
    for x in found:
        assert LIBRARY.decode([int(i) for i in x]) == text and len(x) > len(ids(text))
    assert ids(text, 3, 0.2) == ids(text, 3, 0.2)
    assert all(len(ids("abc", k, 1.0)) == 4 for k in range(3))


def test_rows(spark, docs):
    rows = [(1, "a ▁ b"), (2, None), (3, ""), (4, " lead  and trail \n"), (5, "word " * 20000), (1, "a ▁ b"), (None, "x"), (6, "z" * 3000)]
    got = sd.dropout_ids(docs(rows), PATH).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        if len(text or "") < 5000:
            assert list(r.ids) == plain(text or "", sd.document_key(sd.SEED, doc_id), sd.RATE)
    digests = sd.dropout_digests(docs(rows), PATH).collect()
    assert all(r.text_crc32 == r.decoded_crc32 for r in digests)
    assert sd.dropout_ids(docs([]), PATH).count() == 0
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, ids int")
    assert sd.dropout_ids(df, PATH).first().lossless


def test_each_document_and_occurrence_draws_its_own_dropout(docs):
    text = WORDS * 30
    got = {r.doc_id: r.ids for r in sd.dropout_ids(docs([(i, text) for i in range(1000)]), PATH).collect()}
    assert len({tuple(x) for x in got.values()}) == 1000
    whole = sd.pieces(PATH).ids[sd.pieces(PATH).symbol["▁international"]]
    kept = [x.count(whole) for x in got.values()]
    assert all(3 < k < 30 for k in kept)


def test_a_long_text_in_stretches_has_the_same_ids(monkeypatch):
    text = ("tokenization  of ▁ words\n\nand é🙂 lines " + "y" * 90 + "\n ") * 20
    whole = ids(text, 5, 0.2)
    for size in (1, 7, 100):
        monkeypatch.setattr(sd, "STRETCH", size)
        assert ids(text, 5, 0.2) == whole
