"""Secret scan: all rules in one minimised byte automaton, read in one pass over many documents at once."""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import documents, query, slices, texts, utf8


@dataclass(frozen=True)
class Rule:
    """``head`` (a regex over ASCII) followed by a run of ``body`` characters, at least one if there is a body.

    A match takes the longest head and then the whole run; matches of a rule go from left to right without
    overlap, and those with a run below ``least`` are dropped afterwards. ``scan`` body characters are
    demanded by the automaton: more than one only for a rule without head, where a short run hides nothing.
    """

    kind: str
    head: str
    body: str = ""
    least: int = 1
    scan: int = 1


BASE_RULES = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, 24),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("stripe", "sk_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 10),
    Rule("private_key", "-----BEGIN( RSA| EC| DSA| OPENSSH)? PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson automaton over bytes; ``reverse`` reads its words backwards."""

    def __init__(self, reverse: bool):
        self.reverse, self.empty, self.steps = reverse, [], []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, fold: bool = False) -> int:
        """Append the parsed regex after ``start``; returns its end."""
        for kind, value in reversed(list(tree)) if self.reverse else list(tree):
            start = self.node(kind, value, start, fold)
        return start

    def node(self, kind, value, start: int, fold: bool) -> int:
        if kind in (op.LITERAL, op.IN):
            end = self.state()
            self.steps[start].append((byte_set(kind, value, fold), end))
            return end
        if kind is op.SUBPATTERN:
            _, more, _, inner = value
            return self.add(inner, start, fold or bool(more & 2))
        if kind is op.BRANCH:
            end = self.state()
            for inner in value[1]:
                self.empty[self.add(inner, start, fold)].append(end)
            return end
        if kind is op.MAX_REPEAT:
            low, high, inner = value
            for _ in range(low):
                start = self.add(inner, start, fold)
            if high is op.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop, fold)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(inner, start, fold)
            self.empty[start].append(end)
            return end
        raise ValueError(f"not in a rule: {kind}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def byte_set(kind, value, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for k, v in [(kind, value)] if kind is op.LITERAL else value:
        if k is op.LITERAL:
            found.add(v)
        elif k is op.RANGE:
            found.update(range(v[0], v[1] + 1))
        else:
            raise ValueError(f"not in a rule: {k}")
    if fold:
        found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
    if max(found) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(found)


def determinise(nfa: _Nfa, start: int, accepts: list[int], unanchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, bit mask of accepted rules by state) by subset construction and minimisation. State 0 starts."""
    first = nfa.closure([start])
    known, order, rows = {first: 0}, [first], []
    for subset in order:
        row, moves = np.zeros(256, np.int64), {}
        for s in subset:
            for on, t in nfa.steps[s]:
                for b in on:
                    moves.setdefault(b, set()).add(t)
        base = first if unanchored else frozenset()
        for b in range(256):
            nxt = nfa.closure(moves[b]) | base if b in moves else base
            if nxt not in known:
                known[nxt] = len(order)
                order.append(nxt)
            row[b] = known[nxt]
        rows.append(row)
    table = np.array(rows)
    marks = np.array([sum(1 << r for r, a in enumerate(accepts) if a in subset) for subset in order], np.int64)
    # Moore's refinement: states are equal while marks and successors' blocks are
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    pick = np.unique(block, return_index=True)[1]
    low = np.argsort([(marks[p] != 0) for p in pick], kind="stable")  # accepting states last
    name = np.empty(len(pick), np.int64)
    name[low] = np.arange(len(pick))
    table, marks, begin = name[block[table[pick[low]]]], marks[pick[low]], name[block[0]]
    swap = np.arange(len(pick))
    swap[[0, begin]] = swap[[begin, 0]]
    return swap[table[swap]], marks[swap]


class Automaton:
    """All rules, compiled once: ``scan`` gives the places where a match of each rule begins."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa = _Nfa(reverse=True)
        start = nfa.state()
        accepts = []
        for r in rules:
            at = nfa.state()
            nfa.empty[start].append(at)
            accepts.append(nfa.add(parser.parse(r.head + (f"{r.body}{{{r.scan}}}" if r.body else "")), at))
        table, self.marks = determinise(nfa, start, accepts, unanchored=True)
        self.first_accept = int(np.argmax(self.marks > 0))
        if (self.marks[self.first_accept :] == 0).any():
            raise ValueError("accepting states come last")
        self.reset = (table == table[0]).all(axis=0)  # bytes after which nothing before matters
        self.table = (table * 256).astype(np.int32).ravel()
        self.heads, self.bodies = [], []
        for r in rules:
            nfa = _Nfa(reverse=False)
            at = nfa.state()
            self.heads.append([x.tolist() for x in determinise(nfa, at, [nfa.add(parser.parse(r.head), at)], unanchored=False)])
            self.bodies.append(byte_set(*parser.parse(r.body)[0], False) if r.body else frozenset())

    def starts(self, data: np.ndarray, offsets: np.ndarray, piece: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(position, mask of rules) of all match starts; one pass from right to left over all texts side by side.

        Long texts are cut after bytes that bring every state to the same one, so the pieces are independent.
        """
        lo, hi = int(offsets[0]), int(offsets[-1])
        cuts = lo + 1 + np.flatnonzero(self.reset[data[lo:hi]])
        if len(cuts):
            at = np.searchsorted(cuts, np.arange(lo, hi, piece))
            cuts = np.unique(cuts[at[at < len(cuts)]])
        edges = np.unique(np.concatenate([offsets, cuts]))
        begin, end = edges[:-1], edges[1:]
        order = np.argsort(begin - end, kind="stable")
        at, length = end[order], (end - begin)[order]
        alive = len(at) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), "right")
        state, places, masks = np.zeros(len(at), np.int32), [], []
        edge = self.first_accept * 256
        for w in alive:
            s, a = state[:w], at[:w]
            a -= 1
            s += data[a]
            np.take(self.table, s, out=s, mode="clip")
            if s.max() >= edge:
                hit = np.flatnonzero(s >= edge)
                places.append(a[hit])
                masks.append(self.marks[s[hit] >> 8])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, masks = np.concatenate(places), np.concatenate(masks)
        order = np.argsort(places)
        return places[order], masks[order]

    def end(self, rule: int, text: bytes, at: int) -> tuple[int, int]:
        """(end of the longest head, end of the run after it) of a match that starts at ``at``."""
        table, accepts = self.heads[rule]
        state, head = 0, at if accepts[0] else -1
        for i in range(at, len(text)):
            state = table[state][text[i]]
            if accepts[state]:
                head = i + 1
            elif table[state][0] == state and table[state] == [state] * 256:
                break
        body, i = self.bodies[rule], head
        while i < len(text) and text[i] in body:
            i += 1
        return head, i

    def spans(self, text: bytes, places: list[int], masks: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the matches in one text, in bytes."""
        found = []
        for r, rule in enumerate(self.rules):
            free = 0
            for at, mask in zip(places, masks, strict=True):
                if mask >> r & 1 and at >= free:
                    head, free = self.end(r, text, at)
                    if not rule.body or free - head >= rule.least:
                        found.append((at, r, free))
        return sorted(found)


SPANS = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): the matches of all rules in each whole text, by start and then in the rules' order.

    Positions are code points, ends exclusive. Null and empty texts have no spans; repeated rows are
    scanned one by one; other columns are ignored. The compiled arrays (a few hundred states) go to the
    tasks with the function. There is no shuffle.
    """
    automaton = Automaton(rules)
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 8 << 20):
                places, masks = automaton.starts(data, offsets[i : j + 1])
                owner = np.searchsorted(offsets[i : j + 1], places, "right") - 1
                rows = [[] for _ in range(j - i)]
                bounds = np.searchsorted(owner, np.arange(j - i + 1))
                for k in np.unique(owner):
                    text = data[offsets[i + k] : offsets[i + k + 1]]
                    own = slice(bounds[k], bounds[k + 1])
                    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    found = automaton.spans(text.tobytes(), (places[own] - offsets[i + k]).tolist(), masks[own].tolist())
                    rows[k] = [{"kind": kinds[r], "start": int(before[s]), "end": int(before[e])} for s, r, e in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(documents(spark, folder))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[number(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
