"""Secret scans by one combined deterministic automaton.

The expressions of all rules go into one nondeterministic automaton over bytes, read from
right to left; subset construction and partition refinement turn it into a minimal
transition array. One pass over a text's bytes, backwards, marks for every rule the places at
which a match of its whole expression begins. From the leftmost of these that lies beyond
the last match, the rule's own minimal automaton is followed forwards to the longest end.
Matches of a rule do not overlap, so both passes are linear in the text, whatever it holds.

A rule is a head and a tail; a match counts only if its tail is long enough, and one that is too
short still takes up its place. A rule with a closing carries its match on over line breaks, to
the closing of the same label or to the end of the text; what it opens again in between belongs
to the same span.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_slices, keyed_text, raw_texts, slices

#: Expressions: ("set", bytes), ("seq", parts), ("or", parts), ("many", part, least, most or None).
Expression = tuple


def one_of(ranges: str) -> Expression:
    """One byte out of ranges such as ``A-Z`` and single characters, a dash last."""
    found, i = set(), 0
    while i < len(ranges):
        if ranges[i + 1 : i + 2] == "-" and i + 2 < len(ranges):
            found.update(range(ord(ranges[i]), ord(ranges[i + 2]) + 1))
            i += 3
        else:
            found.add(ord(ranges[i]))
            i += 1
    return "set", frozenset(found)


def seq(*parts: Expression | str) -> Expression:
    """Parts one after another; strings stand for themselves."""
    return "seq", tuple(
        x if isinstance(p, tuple) else ("set", frozenset((x,))) for p in parts for x in ((p,) if isinstance(p, tuple) else p.encode())
    )


def either(*parts: Expression | str) -> Expression:
    return "or", tuple(map(seq, parts))


def many(part: Expression, least: int = 1, most: int | None = None) -> Expression:
    return "many", part, least, most


def maybe(part: Expression) -> Expression:
    return many(part, 0, 1)


def any_case(e: Expression) -> Expression:
    """Letters of the expression in either case."""
    if e[0] == "set":
        return "set", frozenset(ord(x) for b in e[1] for x in {chr(b), chr(b).lower(), chr(b).upper()} if x.isascii())
    if e[0] == "many":
        return many(any_case(e[1]), *e[2:])
    return e[0], tuple(map(any_case, e[1]))


def holds(e: Expression, byte: int) -> bool:
    return byte in e[1] if e[0] == "set" else any(holds(x, byte) for x in (e[1:2] if e[0] == "many" else e[1]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: head and tail, least length of the tail, and what closes it (``{}``: the match without its dashes and BEGIN)."""

    kind: str
    head: Expression
    tail: Expression
    least: int = 0
    closing: str = ""


QUOTE, WORD, URL_WORD = one_of("\"'"), one_of("A-Za-z0-9"), one_of("A-Za-z0-9_-")
_KEYWORD = either("password", "passwd", "secret", "token", seq("api", maybe(one_of("_")), "key"))
_ASSIGNED = seq(_KEYWORD, maybe(QUOTE), many(one_of(" "), 0), one_of(":="), many(one_of(" "), 0), maybe(QUOTE))
_JWT_PART = many(URL_WORD)
#: The first three are the base rules; the others are what this operator adds.
RULES = (
    Rule("assign", any_case(_ASSIGNED), many(one_of("A-Za-z0-9+/_.=-")), 8),
    Rule("access", seq("AKIA"), many(one_of("A-Z0-9")), 12),
    Rule("hex", seq(), many(one_of("0-9a-f"), 32)),
    Rule("pem", seq("-----BEGIN "), seq(many(one_of("A-Z "), 0), "PRIVATE KEY-----"), closing="-----END {}-----"),
    Rule("forge", seq("gh", one_of("pousr"), "_"), many(WORD), 36),
    Rule("chat", seq("xox", one_of("abprs"), "-"), many(one_of("A-Za-z0-9-")), 10),
    Rule("cloud", seq("AIza"), many(URL_WORD), 35),
    Rule("jwt", seq("eyJ"), seq(_JWT_PART, ".eyJ", _JWT_PART, ".", _JWT_PART)),
)
BASE = ("assign", "access", "hex")


class Automaton:
    """Minimal transition array of some expressions: ``step[state + byte]`` is the next state.

    States are multiples of 256; those from ``accept`` on end a match of the expressions whose bits
    are in ``fired[state >> 8]``; ``dead`` leads nowhere. A searching automaton may begin anywhere,
    others at the first byte only; a backward one takes the bytes from right to left.
    """

    def __init__(self, expressions: list[Expression], searching: bool = False, backward: bool = False) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.backward = backward
        start, ends = self.node(), {}
        for i, e in enumerate(expressions):
            first, last = self.build(e)
            self.empty[start].append(first)
            ends[last] = 1 << i
        table, fired = self.determine(start, ends, searching)
        self.minimise(table, fired)
        del self.empty, self.moves

    def node(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def build(self, e: Expression) -> tuple[int, int]:
        """First and last node of an expression (Thompson's construction)."""
        first = last = self.node()
        if e[0] == "set":
            last = self.node()
            self.moves[first] = (e[1], last)
        elif e[0] == "seq":
            for part in reversed(e[1]) if self.backward else e[1]:
                a, b = self.build(part)
                self.empty[last].append(a)
                last = b
        elif e[0] == "or":
            last = self.node()
            for part in e[1]:
                a, b = self.build(part)
                self.empty[first].append(a)
                self.empty[b].append(last)
        else:
            _, part, least, most = e
            for k in range(most if most is not None else least + 1):
                a, b = self.build(part)
                self.empty[last].append(a)
                if k >= least:
                    self.empty[b if most is None else last].append(a if most is None else b)
                if most is None and k == least:
                    end = self.node()
                    self.empty[last].append(end)
                    self.empty[b].append(end)
                    b = end
                last = b
        return first, last

    def closure(self, nodes: set[int]) -> frozenset[int]:
        found, todo = set(nodes), list(nodes)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(x for x in found if self.moves[x] or not self.empty[x])

    def determine(self, start: int, ends: dict[int, int], searching: bool) -> tuple[list[list[int]], list[int]]:
        """Subset construction; a searching automaton keeps the start among the nodes of every state."""
        root = self.closure({start})
        always = root if searching else frozenset()
        number, todo, table, fired = {root: 0}, [root], [], []
        for state in todo:
            by_byte: list[set[int]] = [set() for _ in range(256)]
            for x in state:
                if self.moves[x]:
                    for b in self.moves[x][0]:
                        by_byte[b].add(self.moves[x][1])
            row, known = [], {}
            for targets in map(frozenset, by_byte):
                if targets not in known:
                    following = self.closure(targets) | always
                    if following not in number:
                        number[following] = len(number)
                        todo.append(following)
                    known[targets] = number[following]
                row.append(known[targets])
            table.append(row)
            fired.append(sum(bit for end, bit in ends.items() if end in state))
        return table, fired

    def minimise(self, table: list[list[int]], fired: list[int]) -> None:
        """Partition refinement (Moore); accepting states are numbered last."""
        part = [sorted(set(fired)).index(f) for f in fired]
        while True:
            ids: dict[tuple, int] = {}
            refined = [ids.setdefault((part[i], *(part[x] for x in row)), len(ids)) for i, row in enumerate(table)]
            if len(ids) == len(set(part)):
                break
            part = refined
        sample: dict[int, int] = {}
        for i, p in enumerate(part):
            sample.setdefault(p, i)
        order = sorted(sample, key=lambda p: (fired[sample[p]] > 0, p))
        at = {p: k for k, p in enumerate(order)}
        self.start = at[part[0]] << 8
        self.accept = sum(not fired[sample[p]] for p in order) << 8
        self.fired = [fired[sample[p]] for p in order]
        self.step = [at[part[x]] << 8 for p in order for x in table[sample[p]]]
        barren = [k for k in range(len(order)) if not self.fired[k] and set(self.step[k << 8 : (k + 1) << 8]) == {k << 8}]
        self.dead = barren[0] << 8 if barren else -1

    def beginnings(self, raw: bytes) -> list[tuple[int, int]]:
        """(place, bits of the expressions that match from there on), from right to left, in one pass.

        No expression of a line break matches across one, so every line begins anew; only lines
        that hold a match are followed once more, for its places.
        """
        step, accept, bits, start = self.step, self.accept, self.fired, self.start
        found, end = [], len(raw)
        for line in raw[::-1].split(b"\n"):
            state = start
            for byte in line:
                state = step[state + byte]
                if state >= accept:
                    break
            else:
                end -= len(line) + 1
                continue
            state = start
            for i, byte in enumerate(line, 1):
                state = step[state + byte]
                if state >= accept:
                    found.append((end - i, bits[state >> 8]))
            end -= len(line) + 1
        return found

    def longest(self, raw: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        step, accept, dead = self.step, self.accept, self.dead
        state = self.start
        end = start if state >= accept else -1
        for i in range(start, len(raw)):
            state = step[state + raw[i]]
            if state >= accept:
                end = i + 1
            elif state == dead:
                break
        return end


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """The combined automaton that marks where matches of any rule begin; none may hold a line break."""
    if any(holds(e, 10) for r in rules for e in (r.head, r.tail)):
        raise ValueError("a rule's expression may not hold a line break")
    return Automaton([seq(r.head, r.tail) for r in rules], searching=True, backward=True)


@lru_cache(maxsize=64)
def parts(rule: Rule) -> tuple[Automaton, Automaton]:
    return Automaton([rule.head]), Automaton([rule.tail])


def byte_spans(raw: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule index, end) in bytes of every valid match, by start, then rule."""
    found, done = [], [0] * len(rules)
    for start, bits in reversed(automaton(rules).beginnings(raw)):
        for i, rule in enumerate(rules):
            if not bits >> i & 1 or start < done[i]:
                continue
            head, tail = parts(rule)
            middle = head.longest(raw, start)
            done[i] = end = tail.longest(raw, middle)
            if end - middle < rule.least:
                continue
            if rule.closing:
                mark = rule.closing.encode().replace(b"{}", raw[middle : end - 5])
                at = raw.find(mark, end)
                done[i] = end = len(raw) if at < 0 else at + len(mark)
            found.append((start, i, end))
    return sorted(found)


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if raw.isascii():
        return spans
    marks = sorted({x for a, _, b in spans for x in (a, b)})
    at, before, done = {}, 0, 0
    for x in marks:
        before += len(raw[done:x].decode("utf-8"))
        at[x], done = before, x
    return [(at[a], i, at[b]) for a, i, b in spans]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per document.

    Null and empty texts have no spans. Offsets count code points, ends are exclusive; ties
    in start go by the order of the rules. Repeated rows are scanned alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = defaultdict(list)
            for raw in raw_texts(part):
                spans = in_code_points(raw or b"", byte_spans(raw or b"", rules))
                named = [(rules[i].kind, f"{rules[i].kind}:{a}:{b}") for a, i, b in spans]
                for kind in BASE:
                    columns[f"n_{kind}"].append(sum(k == kind for k, _ in named))
                base = ",".join(s for k, s in named if k in BASE)
                columns["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                columns["spans"].append(",".join(s for _, s in named))
            counts = [pa.array(columns[f"n_{k}"], pa.int64()) for k in BASE]
            digests = [pa.array(columns[c], pa.string()) for c in ("base_sha256", "spans")]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, *digests], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return keyed_text(docs).mapInArrow(run, schema)


def redacted(raw: bytes, rules: tuple[Rule, ...] = RULES, mask: bytes = b"[SECRET]") -> bytes:
    """Text with every span, overlapping ones as one, replaced by the mask."""
    out, done, free = [], 0, 0
    for start, _, end in byte_spans(raw, rules):
        if start >= free:
            out += [raw[done:start], mask]
        done = free = max(free, end)
    return b"".join([*out, raw[done:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked in text and n_chars brought up to date.

    Only the text meets Python. Null texts stay null and keep their n_chars.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        done = [None if raw is None else redacted(raw, rules).decode("utf-8") for part in in_slices(texts) for raw in part]
        return pa.array(done, pa.string())

    done = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        done = done.withColumn(
            "n_chars",
            F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)),
        )
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


QUERIES = {"op10_secret_scans": query}
