"""Secret scans (operator 9): one combined deterministic automaton for all rules.

Method. Every rule's regex is parsed to a nondeterministic automaton; their union, unanchored, is made deterministic by
subset construction over byte classes and then minimised. One pass over the bytes of a text through the transition
arrays says at which byte which rules have just matched. Each rule also has two small automata made in the same way, one
of its reversed regex, that finds the possible starts of a match from its first end, and one of the regex itself,
that finds the greatest end. Matches are leftmost and do not overlap within a rule; those that fail a rule's
length condition use up their bytes and are dropped.

Beside the three base kinds the scan reports ``github`` and ``pem`` spans.

Defined cases: null text counts as empty and has no spans; places are in code points; spans are ordered by start and
then by the order of the rules; rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem, itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    lead: str            # the part before the value
    value: str
    least_value: int     # bytes of the value
    least: int           # bytes of the match
    find: str            # a regex that is in every match which passes, and lets a scan report fewer places


# The base rules. ``(?i)`` holds for the letters of its group. Rules after the third are further ones.
RULES = [
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 8, 0, ""),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 0, 16, ""),
    Rule("hex", r"", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}[0-9a-f]*"),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36, 0, ""),
    Rule("pem", r"-----BEGIN\x20", r"[A-Z\x20]*PRIVATE\x20KEY-----", 0, 0, ""),
]
BASE = 3


# Regex to nondeterministic automaton ---------------------------------------------------------------------------------

class Nfa:
    """States are integers; ``moves[s]`` has (bytes, target) and ``free[s]`` targets reached without a byte."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def parse(pattern: str):
    """A tree of ('set', bytes), ('seq', [..]), ('alt', [..]) and ('rep', tree, least, most or None)."""
    at, fold = 0, False

    def escape() -> int:
        nonlocal at
        c = pattern[at + 1]
        at += 4 if c == "x" else 2
        return int(pattern[at - 2:at], 16) if c == "x" else ord(c)

    def one(b: int) -> set[int]:
        return {ord(x) for x in (chr(b).lower(), chr(b).upper())} if fold else {b}

    def atom():
        nonlocal at, fold
        c = pattern[at]
        if c == "(":
            before, at = fold, at + 1
            if pattern.startswith("?i:", at):
                fold, at = True, at + 3
            tree = alternatives()
            at, fold = at + 1, before
            return tree
        if c == "[":
            at, out = at + 1, set()
            while pattern[at] != "]":
                low = escape() if pattern[at] == "\\" else ord(pattern[at])
                at += pattern[at - 1] != "\\" and ord(pattern[at]) == low
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    high, at = ord(pattern[at + 1]), at + 2
                    out |= set(range(low, high + 1))
                else:
                    out |= one(low)
            at += 1
            return "set", frozenset(out)
        if c == "\\":
            return "set", frozenset(one(escape()))
        at += 1
        return "set", frozenset(one(ord(c)))

    def sequence():
        nonlocal at
        out = []
        while at < len(pattern) and pattern[at] not in "|)":
            tree = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                if c == "{":
                    end = pattern.index("}", at)
                    low, _, high = pattern[at + 1:end].partition(",")
                    bounds = int(low), (int(high) if high else None) if "," in pattern[at:end] else int(low)
                    at = end + 1
                else:
                    bounds, at = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c], at + 1
                tree = ("rep", tree, *bounds)
            out.append(tree)
        return "seq", out

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            out.append(sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    return alternatives()


def build(nfa: Nfa, tree, start: int, reverse: bool = False) -> int:
    """Adds ``tree`` from ``start``; returns its end state."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "seq":
        for x in reversed(tree[1]) if reverse else tree[1]:
            start = build(nfa, x, start, reverse)
        return start
    if kind == "alt":
        end = nfa.state()
        for x in tree[1]:
            nfa.free[build(nfa, x, start, reverse)].append(end)
        return end
    _, inner, least, most = tree
    for _ in range(least):
        start = build(nfa, inner, start, reverse)
    end = nfa.state()
    nfa.free[start].append(end)
    if most is None:
        again = nfa.state()
        nfa.free[start].append(again)
        last = build(nfa, inner, again, reverse)
        nfa.free[last] += [again, end]
    else:
        for _ in range(most - least):
            start = build(nfa, inner, start, reverse)
            nfa.free[start].append(end)
    return end


# Deterministic automata ----------------------------------------------------------------------------------------------

class Dfa:
    """``classes`` maps a byte to its class, ``table[state][class]`` is the next state, ``mask[state]`` the rules that end."""

    def __init__(self, classes: bytes, table: list[list[int]], mask: list[int], start: int):
        self.classes, self.table, self.mask, self.start = classes, table, mask, start
        rows: list[list] = [[] for _ in table]
        for s, row in enumerate(table):
            rows[s] += [rows[t] for t in row]
            rows[s].append(mask[s])
        self.rows = rows

    def flags(self, data: bytes) -> bytes:
        """For every byte the rules that match up to it: the transition arrays are followed without a loop in Python."""
        return bytes(map(itemgetter(-1), accumulate(data.translate(self.classes), getitem, initial=self.rows[self.start])))[1:]

    def ends(self, data: bytes, at: int, step: int) -> Iterator[int]:
        """Places where a match that begins at ``at`` ends, ahead (step 1) or backwards (-1), until none can follow."""
        row, classes = self.rows[self.start], self.classes
        dead = len(self.table) - 1
        while 0 <= at < len(data):
            row = row[classes[data[at]]]
            if row is self.rows[dead]:
                return
            at += step
            if row[-1]:
                yield at


def determinise(nfa: Nfa, start: int, final: dict[int, int], loop: bool) -> Dfa:
    """Subset construction and minimisation; ``final`` maps an end state to its bit; ``loop``: matches begin anywhere."""
    sets = {s for moves in nfa.moves for s, _ in moves}
    groups: dict[tuple, int] = {}
    classes = bytes(groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256))
    sample = [classes.index(k) for k in range(len(groups))]
    base = nfa.closure([start])
    index, order, table = {base: 0}, [base], []
    for states in order:
        row = []
        for b in sample:
            to = {t for s in states for bytes_, t in nfa.moves[s] if b in bytes_}
            to = nfa.closure(to) | (base if loop else frozenset())
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        table.append(row)
    mask = [functools.reduce(int.__or__, (final.get(s, 0) for s in states), 0) for states in order]
    block = mask[:]
    while True:  # Moore: split blocks by the blocks they lead to until nothing splits
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *(block[t] for t in table[s])), len(names)) for s in range(len(table))]
        if len(set(finer)) == len(set(block)):
            break
        block = finer
    names = {}
    block = [names.setdefault(x, len(names)) for x in block]
    first = {b: s for s, b in reversed(list(enumerate(block)))}
    table2 = [[block[t] for t in table[first[b]]] for b in range(len(first))]
    mask2 = [mask[first[b]] for b in range(len(first))]
    table2.append([len(table2)] * len(sample))  # a dead state of its own, last
    mask2.append(0)
    empty = index.get(frozenset())
    if empty is not None:
        gone = block[empty]
        table2 = [[len(table2) - 1 if t == gone else t for t in row] for row in table2]
    return Dfa(classes, table2, mask2, block[0])


def anchored(pattern: str, reverse: bool = False) -> Dfa:
    nfa = Nfa()
    start = nfa.state()
    return determinise(nfa, start, {build(nfa, parse(pattern), start, reverse): 1}, False)


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        if len(rules) > 8:
            raise ValueError("one scan takes up to eight rules")
        nfa = Nfa()
        start, final = nfa.state(), {}
        for k, r in enumerate(rules):
            own = nfa.state()
            nfa.free[start].append(own)
            final[build(nfa, parse(r.find or r.lead + r.value), own)] = 1 << k
        self.rules = rules
        self.all = determinise(nfa, start, final, True)
        self.ahead = [anchored(r.lead + r.value) for r in rules]
        self.back = [anchored(r.lead + r.value, True) for r in rules]
        self.lead = [anchored(r.lead) if r.lead else None for r in rules]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) of every span, ordered."""
        data = text.encode("utf-8", "surrogatepass")
        flags = self.all.flags(data)
        if not flags.strip(b"\0"):
            return []
        hits = np.frombuffer(flags, np.uint8)
        found = []
        for k, r in enumerate(self.rules):
            last = 0
            for at in np.flatnonzero(hits & (1 << k)).tolist():
                if at < last:
                    continue
                starts = [s + 1 for s in self.back[k].ends(data, at, -1) if s + 1 >= last]
                if not starts:
                    continue
                begin = min(starts)
                end = max(self.ahead[k].ends(data, begin, 1))
                last = end
                lead = max(self.lead[k].ends(data, begin, 1)) if self.lead[k] else begin
                if end - lead >= r.least_value and end - begin >= r.least:
                    found.append((begin, k, end))
        if not text.isascii():
            place = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(place[a]), k, int(place[b])) for a, k, b in found]
        return sorted(found)


@functools.lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every whole text. A map-only plan: no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for value in batch.column(1):
                found = s.scan(value.as_py() or "")
                said = [(k, f"{s.rules[k].kind}:{a}:{b}") for a, k, b in found]
                for k in range(BASE):
                    counts[k].append(sum(x == k for x, _ in said))
                digests.append(hashlib.sha256(",".join(x for k, x in said if k < BASE).encode()).hexdigest())
                spans.append(",".join(x for _, x in said))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
