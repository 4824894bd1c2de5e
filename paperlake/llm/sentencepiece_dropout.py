"""SentencePiece merges with seeded dropout, and lossless decoding.

A SentencePiece model of merge type never joins pieces over a space that follows another
character, nor over characters that no longer piece holds (a line break here), so a text is
cut there into units. In each unit an agenda holds the candidate merges by piece score and
place; a candidate is skipped where a keyed hash of (seed, doc_id, number of the unit in the
text, place, piece) falls below the dropout rate, so each occurrence of a word draws its own.
The outcome depends on these alone: the same seed gives the same ids on any cluster, another
seed other segmentations. With rate 0 the ids equal the library's.

All units of a slice work off their agendas at once: units of like length are the columns of
an array, and one step takes each column's best candidate, draws, and merges or skips it.
Nothing is remembered from one slice to the next, so memory does not grow with the corpus.
Units too long for such an array have an agenda of their own, as a heap.

A literal U+2581, which the library would read as a space, is written as bytes, and all
characters outside the vocabulary fall back to bytes, so that decoding gives the very text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import documents, keyed_text, raw_texts, slices

SPACE = "▁"
RATE = 0.1
SEED = 7
#: Widths of the arrays that hold units; longer units are merged by a heap.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64)
#: Characters of one text that are encoded at once.
STRETCH = 1 << 20
NONE = np.int32(2**31 - 1)
SYMBOL_BITS = 21
GOLDEN, PLACE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Where a text may be cut: before a line break, or a space that begins a unit.
CUT = re.compile(f"\n|(?<=[^ \n{SPACE}]) ")


def finalised(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """Which piece two neighbouring symbols make: a table by hash, and a second one for what collides there."""

    FACTOR = np.uint64(GOLDEN)

    def __init__(self, found: dict[int, int]) -> None:
        keys, ranks = (np.array(list(x), np.int64) for x in (found, found.values()))
        self.levels = []
        for bits in (20, 18, 16):
            slot = self.slot(keys, bits)
            taken, first = np.unique(slot, return_index=True)
            at, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            at[taken], value[taken] = keys[first], ranks[first]
            self.levels.append((bits, at, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(ranks[order], NONE).astype(np.int32)

    def slot(self, keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * self.FACTOR) >> np.uint64(64 - bits)).view(np.int64)

    def made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, NONE where there is none; a negative symbol pairs with nothing."""
        keys = (left.astype(np.int64) << SYMBOL_BITS) | right
        bits, at, value = self.levels[0]
        slot = self.slot(keys, bits)
        met = at[slot]
        out = np.where(met == keys, value[slot], NONE)
        open_ = np.flatnonzero((met != keys) & (met >= 0) & (keys >= 0))
        for bits, at, value in self.levels[1:]:
            key = keys[open_]
            slot = self.slot(key, bits)
            met = at[slot]
            out[open_] = np.where(met == key, value[slot], NONE)
            open_ = open_[(met != key) & (met >= 0)]
        if len(open_) and len(self.keys) > 1:
            key = keys[open_]
            place = np.minimum(np.searchsorted(self.keys[:-1], key), len(self.keys) - 2)
            out[open_] = np.where(self.keys[place] == key, self.ranks[place], NONE)
        return out


class Pieces:
    """Vocabulary of a model file: its pieces as symbols, and the bytes that each id stands for.

    Symbols are the pieces by falling score, then (from ``count`` on) single characters by code.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = [0] * 256
        own: list[tuple[float, str, int]] = []
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                own.append((-model.get_score(i), piece, i))
                self.text.append(piece.replace(SPACE, " ").encode())
        own.sort()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for _, p, _ in own):
            raise ValueError("this vocabulary joins pieces over spaces or line breaks")
        self.byte = np.array(byte)
        self.count = len(own)
        self.ids = np.array([i for _, _, i in own])
        self.symbol = {p: k for k, (_, p, _) in enumerate(own)}
        #: Place of each piece's score among all scores, and the piece of a score (-1 where several share it).
        self.order = np.unique([cost for cost, _, _ in own], return_inverse=True)[1].astype(np.int32)
        self.holder = np.where(np.bincount(self.order) > 1, -1, np.unique(self.order, return_index=True)[1]).astype(np.int32)
        self.draws = np.array([xxhash.xxh64_intdigest(p.encode()) for _, p, _ in own], np.uint64)
        self.of_code = np.arange(0x110000, dtype=np.int32) + self.count
        for p, k in self.symbol.items():
            if len(p) == 1:
                self.of_code[ord(p)] = k
        self.of_code[ord(" ")] = self.of_code[ord(SPACE)]
        self.found: dict[int, int] = {}
        for k, (_, p, _) in enumerate(own):
            for i in range(1, len(p)):
                a, b = self.part(p[:i]), self.part(p[i:])
                if a >= 0 and b >= 0:
                    self.found[a << SYMBOL_BITS | b] = k
        self.of_code[ord(SPACE)] = self.count + ord(SPACE)
        self.pairs = Pairs(self.found)

    def part(self, p: str) -> int:
        return int(self.of_code[ord(p)]) if len(p) == 1 else self.symbol.get(p, -1)

    def skipped(self, base: np.ndarray, place: np.ndarray, piece: np.ndarray, threshold: int) -> np.ndarray:
        """Whether the candidates at these places, under the keys of their units, are left out."""
        return finalised(base ^ (self.draws[piece] + place.astype(np.uint64) * np.uint64(PLACE))) < np.uint64(threshold)

    def merge_all(self, symbols: np.ndarray, base: np.ndarray, threshold: int) -> np.ndarray:
        """Agendas of all columns of ``symbols`` (places by units), one candidate of each at a step; merged places are -1.

        Row ``width`` is where the links of the first and last symbols end.
        """
        width, n = symbols.shape
        done = symbols
        column = np.arange(n)
        symbols = np.vstack([symbols, np.full((1, n), -1, np.int32)])
        right = np.repeat(np.arange(1, width + 2, dtype=np.int16)[:, None], n, axis=1)
        left = np.repeat(np.arange(-1, width, dtype=np.int16)[:, None], n, axis=1)
        right[width], left[0] = width, width
        #: Order of the score and place of each pair in one number, so that the least is the best and leftmost.
        agenda = np.full((width + 1, n), NONE, np.int32)
        for k in range(width - 1):
            agenda[k] = self.packed(self.pairs.made_of(symbols[k], symbols[k + 1]), k)
        while n:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best != NONE)
            if 2 * len(live) < n:
                done[:, column] = symbols[:width]
                column, symbols, right, left, agenda, base, best = (
                    np.take(x, live, axis=-1) for x in (column, symbols, right, left, agenda, base, best)
                )
                n, live = len(live), np.arange(len(live))
                if not n:
                    break
            place, piece = best[live] & 63, self.holder[best[live] >> 6]
            at = place.astype(np.int64) * n + live
            symbol_, right_, left_, agenda_ = (x.reshape(-1) for x in (symbols, right, left, agenda))
            other = right_[at].astype(np.int64) * n + live
            tied = piece < 0
            if tied.any():
                piece[tied] = self.pairs.made_of(symbol_[at[tied]], symbol_[other[tied]])
            if threshold:
                out = self.skipped(base[live], place, piece, threshold)
                agenda_[at[out]] = NONE
                live, place, piece, at, other = (x[~out] for x in (live, place, piece, at, other))
            after = right_[other]
            symbol_[at], symbol_[other], agenda_[other], right_[at] = piece, -1, NONE, after
            after = after.astype(np.int64) * n + live
            left_[after] = place
            agenda_[at] = self.packed(self.pairs.made_of(piece, symbol_[after]), place)
            before = left_[at]
            agenda_[before.astype(np.int64) * n + live] = self.packed(
                self.pairs.made_of(symbol_[before.astype(np.int64) * n + live], piece), before
            )
        done[:, column] = symbols[:width]
        return done

    def packed(self, piece: np.ndarray, place) -> np.ndarray:
        none = piece == NONE
        return np.where(none, NONE, (self.order[np.where(none, 0, piece)] << 6) | place).astype(np.int32)

    def merge_long(self, symbols: list[int], base: int, threshold: int) -> list[int]:
        """The agenda of one unit as a heap; merged places are -1."""
        n, found = len(symbols), self.found.get
        key, one = np.array([base], np.uint64), lambda x: np.array([x])
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            piece = found(symbols[i] << SYMBOL_BITS | symbols[j])
            if piece is not None:
                heappush(agenda, (int(self.order[piece]), i, piece, symbols[i], symbols[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, piece, a, b = heappop(agenda)
            j = right[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            if threshold and self.skipped(key, one(i), one(piece), threshold)[0]:
                continue
            symbols[i], symbols[j] = piece, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                propose(i, k)
            if left[i] >= 0:
                propose(left[i], i)
        return symbols

    def ids_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols in order, and the number of ids of each: one, or its bytes outside the vocabulary."""
        size = np.ones(len(symbols), np.int64)
        hard = np.flatnonzero(symbols >= self.count)
        if not len(hard):
            return self.ids[symbols].astype(np.uint32), size
        codes, which = np.unique(symbols[hard] - self.count, return_inverse=True)
        coded = [self.byte[list(chr(c).encode())] for c in codes.tolist()]
        many = np.array([len(x) for x in coded])
        size[hard] = many[which]
        out = np.repeat(self.ids[np.minimum(symbols, self.count - 1)], size).astype(np.uint32)
        first = (np.cumsum(size) - size)[hard]
        table, start = np.concatenate(coded), np.cumsum(many) - many
        for k in range(int(many.max())):
            some = many[which] > k
            out[first[some] + k] = table[start[which[some]] + k]
        return out, size


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def units_of(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First characters of the units; every text begins one."""
    barrier = (codes == ord("\n")) | (codes == ord(SPACE))
    space = codes == ord(" ")
    first = barrier.copy()
    first[1:] |= barrier[:-1] | (space[1:] & ~space[:-1])
    first[edges] = True
    return np.flatnonzero(first)


def encode_many(
    texts: list[str], keys: list[int], path: str, rate: float, numbers: list[int] | None = None
) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of each text, and how many units it has. ``numbers``: units that went before, where a text is continued."""
    machine, threshold = pieces(path), min(int(rate * 2**64), 2**64 - 1)
    #: At rate 1 nothing may merge, whatever the draw.
    whole = rate >= 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    chars = np.array([len(t) for t in texts], np.int64)
    edges = np.cumsum(chars) - chars
    if not len(codes):
        return [np.zeros(0, np.uint32) for _ in texts], np.zeros(len(texts), np.int64)
    start = units_of(codes, edges[chars > 0])
    size = np.diff(np.append(start, len(codes)))
    text = np.searchsorted(edges + chars, start, side="right")
    units = np.bincount(text, minlength=len(texts))
    number = np.arange(len(start)) - (np.cumsum(units) - units)[text] + np.array(numbers or [0] * len(texts))[text]
    base = finalised((number + 1).astype(np.uint64) * np.uint64(GOLDEN) + np.array(keys, np.uint64)[text])
    symbols = machine.of_code[codes]
    done = symbols.copy()
    low = 1
    for width in WIDTHS[1:] if not whole else ():
        mine = np.flatnonzero((size > low) & (size <= width))
        low = width
        if len(mine):
            place = np.arange(width)[:, None]
            inside = place < size[mine]
            at = start[mine] + np.minimum(place, size[mine] - 1)
            merged = machine.merge_all(np.where(inside, symbols[at], -1).astype(np.int32), base[mine], threshold)
            done[at[inside]] = merged[inside]
    for k in np.flatnonzero(size > WIDTHS[-1]).tolist() if not whole else ():
        part = slice(start[k], start[k] + size[k])
        done[part] = machine.merge_long(symbols[part].tolist(), int(base[k]), threshold)
    kept = done >= 0
    ids, many = machine.ids_of(done[kept])
    total = np.concatenate(([0], np.cumsum(many)))
    held = total[np.concatenate(([0], np.cumsum(kept)))[np.append(edges, len(codes))]]
    return [ids[a:b] for a, b in zip(held, held[1:])], units


def encode(text: str, path: str, key: int, rate: float) -> np.ndarray:
    """Ids of a whole text; an empty text has none. A very long one is encoded in stretches of whole units."""
    found, number, at = [], 0, 0
    text = f" {text}" if text else ""
    while at < len(text):
        cut = CUT.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        (ids,), (units,) = encode_many([text[at:end]], [key], path, rate, [number])
        found.append(ids)
        number, at = number + int(units), end
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def encode_slice(texts: list[str], keys: list[int], path: str, rate: float) -> list[np.ndarray]:
    """Ids of each text of a slice; a slice of several texts is short."""
    if len(texts) == 1:
        return [encode(texts[0], path, keys[0], rate)]
    return encode_many([f" {t}" if t else "" for t in texts], keys, path, rate)[0]


def decode(ids: np.ndarray, path: str) -> bytes:
    """UTF-8 text of the ids: pieces and bytes joined, without the space put before the text."""
    return b"".join(map(pieces(path).text.__getitem__, ids.tolist()))[1:]


def document_key(seed: int, doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


def _coded(docs: DataFrame, path: str, seed: int, rate: float, with_ids: bool) -> DataFrame:
    extra = "ids array<int>" if with_ids else "ids_crc32 long, text_crc32 long, decoded_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [raw or b"" for raw in raw_texts(part)]
            keys = [document_key(seed, i) for i in part.column("doc_id").to_pylist()]
            ids = encode_slice([raw.decode("utf-8") for raw in texts], keys, path, rate)
            back = [decode(x, path) for x in ids]
            lossless = pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())
            lengths = pa.array([len(x) for x in ids], pa.int64())
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).view(np.int32)
                more = [pa.ListArray.from_arrays(offsets, flat)]
            else:
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], map(zlib.crc32, texts), map(zlib.crc32, back)
                more = [pa.array(x, pa.int64()) for x in crcs]
            names = [x.split()[0] for x in extra.split(", ")]
            columns = [part.column("doc_id"), lengths, lossless, *more]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "lossless", *names])

    return keyed_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, lossless boolean, {extra}")


def dropout_ids(docs: DataFrame, path: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, n_tokens, lossless (decoding gives the text), ids.

    Null and empty texts have no ids. Null doc_ids share one key; repeated rows get equal
    ids. Every text is encoded and decoded whole.
    """
    return _coded(docs, path, seed, rate, True)


def dropout_digests(docs: DataFrame, path: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """As ``dropout_ids``, with checksums of ids, text and decoded text in place of the ids."""
    return _coded(docs, path, seed, rate, False)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return dropout_digests(documents(spark, sf_dir), path or model_path())


QUERIES = {"op7_sentencepiece": query}
