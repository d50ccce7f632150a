"""Suffix-array dedup (operator 4): deep-shallow sorting.

Removes every byte that is covered by a LENGTH-byte string which also starts anywhere else in the corpus.

Which suffixes are sorted. Sorting all suffixes of 100 TB would move each byte LENGTH times. Every LENGTH-byte string has one
anchor: the place of the least hash among its GRAM-byte strings (the leftmost on ties), which depends on its content alone. So equal
strings have equal anchors at equal offsets, and only suffixes at anchors, about one in 85 bytes, need to be looked at.
An anchor's context (at most REACH bytes before it and LENGTH from it on) holds all the strings it stands for.

1. Rows are collapsed to distinct texts, named by a 128-bit digest, so copies cost nothing further on and ids are never used as keys. A text of
   two or more rows loses all of itself if it has LENGTH bytes. Texts move once, compressed, into a bucketed table that later steps join without
   moving them again.
2. Anchors are matched by the hash of their GRAM bytes; one that occurs once is done with. Equal contexts within one text, such as those
   of a run of blanks, are one anchor of weight two, and their bytes are covered at once.
3. Anchors with equal contexts form a class; a class of weight two or more is covered whole, and its bytes never move.
4. Classes of one member in a group with other classes (the edges of repeats) are compared: their contexts are fetched, and
   the group's suffixes are put in order from the anchor on, and once more from the anchor backwards, by deep-shallow
   sorting: multikey quicksort over 8-byte words to a shallow depth, then blind tries for what still has a long common
   prefix. From both orders and their common prefixes follows, merging the smaller part into the larger one, how far left and
   right each member agrees with any other (:func:`agreements`).
5. A group with more than LARGE classes is first parted for the tasks: by ranges of offsets, members meet by a hash of what all strings of the
   range share, and those that agree in all the range spans are one (:func:`_refine`). A part of at most LARGE members is sorted as in 4, a larger one is
   parted by finer ranges; in the finest, of one string, equal members are all there is. The result does not depend on LARGE.

Skew. A frequent anchor or class is matched by a broadcast of the keys that hold 1/HEAVY of all rows or more, of which there are at most
HEAVY; all other keys are too small to matter to one task (:func:`codeweave.llm.common.spread_join`).

Equality of texts rests on 128 bits, that of strings on 64-bit hashes that must agree together with the anchor's own 64-bit hash.

Defined cases: null text counts as empty; texts shorter than LENGTH keep all; repeated rows, of one id, of several or of none, are copies of each
other and lose all that is covered; overlapping strings count, and are judged on the input; null and repeated ids are only carried along; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import settle, settle_by, spread_join

LENGTH, GRAM, SHALLOW, LARGE, BLOCK = 200, 32, 64, 512, 1 << 22
REACH = LENGTH - GRAM
BASE = 0x9E3779B97F4A7C15
#: Rows of one output batch, about.
ROWS = 1 << 14


# Anchors -------------------------------------------------------------------------------------------------------------

_powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM-byte string of ``b``."""
    n = len(b)
    up, down = _power_tables(n)
    h = np.cumsum(b * down, dtype=np.uint64)
    g = h[GRAM - 1:].copy()
    g[1:] -= h[:n - GRAM]
    g *= up[:n - GRAM + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xA0761D6478BD642F)
    g ^= g >> np.uint64(32)
    return g


def anchor_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the anchors of all LENGTH-byte strings of ``data``, in order, a block of bytes a time."""
    last = -1
    for s in range(0, len(data) - LENGTH + 1, BLOCK):
        b = np.frombuffer(data, np.uint8, min(len(data) - s, BLOCK + LENGTH - 1), s)
        g = gram_hashes(b)
        low = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        width, need = 1, REACH + 1
        while 2 * width <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if need > width:
            low = np.minimum(low[:len(low) - (need - width)], low[need - width:])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        if at[0] + s == last:
            at = at[1:]
        if len(at):
            last = int(at[-1]) + s
            yield at + s, g[at]


def _flat(data: bytes, at: np.ndarray) -> np.ndarray:
    """Which anchors stand in the inside of a run of one byte, after two others of the same context."""
    lo, hi = max(0, int(at[0]) - REACH), min(len(data), int(at[-1]) + LENGTH)
    b = np.frombuffer(data, np.uint8, hi - lo, lo)
    edges = np.flatnonzero(b[1:] != b[:-1]) + lo
    whole = (at >= REACH) & (at + LENGTH <= len(data)) & (np.searchsorted(edges, at - REACH) == np.searchsorted(edges, at + LENGTH - 1))
    out = np.zeros(len(at), bool)
    out[2:] = whole[2:] & whole[1:-1] & whole[:-2] & (at[2:] - at[:-2] == 2)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def text_anchors(data: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Of one text: (gram hash, context hash, place, weight) of each different context, and the ranges that contexts repeated in it cover."""
    n, kinds, spans = len(data), {}, []
    for at, g in anchor_blocks(data):
        if len(at) > 1024 and 8 * len(at) > at[-1] - at[0]:
            flat = _flat(data, at)
            if flat.any():  # all that a stretch covers; its first two stay and make the class
                ends = np.flatnonzero(np.diff(np.r_[False, flat, False].astype(np.int8)))
                spans += [(int(at[x]) - REACH, int(at[y - 1]) + LENGTH) for x, y in zip(ends[::2], ends[1::2])]
                at, g = at[~flat], g[~flat]
        for p, h in zip(at.tolist(), g.view(np.int64).tolist()):
            c = xxhash.xxh3_64_intdigest(data[max(0, p - REACH):p + LENGTH], min(p, REACH))
            first = kinds.setdefault((h, c), p)
            if first != p:
                if first >= 0:
                    spans.append((max(0, first - REACH), min(n, first + LENGTH)))
                    kinds[h, c] = ~first
                spans.append((max(0, p - REACH), min(n, p + LENGTH)))
        if len(spans) > ROWS:
            spans = merged(spans)
    return [(h, c, p if p >= 0 else ~p, 1 if p >= 0 else 2) for (h, c), p in kinds.items()], merged(spans)


ANCHORS = "h long, c long, k binary, pos long, n int, runs array<long>"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts (``k, z, copies``); a row without ``h`` holds the ranges that a text covers by itself."""
    open_ = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    names = [x.split(" ")[0] for x in ANCHORS.split(", ")]

    def made(cols: list[list]) -> pa.RecordBatch:
        h, c, *rest = (np.array(x, object) if i < 2 else x for i, x in enumerate(cols))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h, c, *rest), kinds)], names)

    cols: list[list] = [[] for _ in names]
    for batch in batches:
        for k, z, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            found, spans = text_anchors(open_.decompress(z.as_py()))
            for h, c, p, n in found:
                for col, v in zip(cols, (h, c - (1 << 64) if c >> 63 else c, k, p, 2 if copies > 1 else n, None)):
                    col.append(v)
            if spans and copies == 1:
                for col, v in zip(cols, (None, None, k, 0, 0, [x for s in spans for x in s])):
                    col.append(v)
            if len(cols[0]) >= ROWS:
                yield made(cols)
                cols = [[] for _ in names]
    if cols[0]:
        yield made(cols)


# Deep-shallow sorting ------------------------------------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Order of ``strings`` (shorter first among prefixes), all of which agree in their first ``depth`` bytes."""
    out: list[int] = []
    todo = [(list(range(len(strings))), depth)]
    while todo:  # multikey quicksort, the least part on top
        items, d = todo.pop()
        if len(items) <= 1:
            out += items
        elif d >= shallow:
            out += _blind_trie(strings, items)
        else:
            words = [int.from_bytes(strings[i][d:d + 8].ljust(8, b"\0"), "big") for i in items]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(items, words) if w < pivot]
            same = [i for i, w in zip(items, words) if w == pivot]
            more = [i for i, w in zip(items, words) if w > pivot]
            todo += [(more, d), (same, d + 8), (less, d)]
    return out


def _blind_trie(strings: list[bytes], items: list[int]) -> list[int]:
    """Order by a trie that keeps only depths and branching bytes; a string is compared with one other a time."""
    root: list = [[items[0]]]  # the top: a leaf (list of equal strings) or (depth, {byte or -1: child})

    def byte(i: int, d: int) -> int:
        return strings[i][d] if d < len(strings[i]) else -1

    for i in items[1:]:
        node = root[0]
        while type(node) is tuple:
            node = node[1].get(byte(i, node[0])) or next(iter(node[1].values()))
        other = node[0]
        d = common(strings[i], strings[other])
        if d == len(strings[i]) == len(strings[other]):
            node.append(i)
            continue
        holder, key, node = root, 0, root[0]
        while type(node) is tuple and node[0] < d:
            holder, key = node[1], byte(i, node[0])
            node = holder[key]
        if type(node) is tuple and node[0] == d:
            node[1][byte(i, d)] = [i]
        else:
            holder[key] = (d, {byte(other, d): node, byte(i, d): [i]})
    out, todo = [], [root[0]]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def agreements(right: list[bytes], left: list[bytes]) -> list[list[tuple[int, int]]]:
    """For members of one group, (l, r) pairs: some other member agrees in l bytes before and r bytes from the anchor, l + r >= LENGTH.

    ``right``: bytes from the anchor on; ``left``: bytes before it, reversed. The union of the pairs' ranges is complete: parts
    of the order by ``right`` are merged by falling common prefix r, the smaller into the larger. For a member x of
    the smaller part the longest agreement to the left is with a neighbour in the left order. If two members of the larger
    part share a string with x, they share it with each other and have been told so before; if one does, it is a
    neighbour too.
    """
    n = len(right)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = deep_shallow(right, GRAM)
    by_left = deep_shallow(left)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    joints = sorted(((common(right[a], right[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    part = list(range(n))  # of each place in ``order``
    members: dict[int, list[int]] = {k: [rank[i]] for k, i in enumerate(order)}

    def top(k: int) -> int:
        while part[k] != k:
            part[k] = part[part[k]]
            k = part[k]
        return k

    for r, k in joints:
        if r + REACH < LENGTH:
            break
        a, b = top(k), top(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members.pop(b)
        for x in small:
            at = bisect_left(large, x)
            i = by_left[x]
            for y in large[max(0, at - 1):at + 1]:
                j = by_left[y]
                l = common(left[i], left[j])  # noqa: E741
                if l + r >= LENGTH:
                    found[i].append((l, r))
                    found[j].append((l, r))
        if 8 * len(small) > len(large):
            members[a] = sorted(large + small)
        else:
            for x in small:
                insort(large, x)
        part[b] = a
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts ordered by group; gives the agreements of the members that are alone in their class."""
    group, rows = None, []

    def report() -> Iterator[pa.RecordBatch]:
        found = agreements([x[p:] for _, _, _, x, p in rows], [x[:p][::-1] for _, _, _, x, p in rows])
        out = [(k, p, [v for pair in f for v in pair]) for (k, p, n, _, _), f in zip(rows, found) if n == 1 and f]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["k", "pos", "pairs"])

    for batch in batches:
        for h, k, pos, n, text, before in zip(*(c.to_pylist() for c in batch.columns)):
            if h != group and rows:
                yield from report()
                rows = []
            group = h
            rows.append((k, pos, n, text, before))
    if rows:
        yield from report()


# Large groups --------------------------------------------------------------------------------------------------------

#: Widths of the ranges of offsets, level by level.
WIDTHS = (43, 7, 1)


def _range_rows(width: int):
    """Per context and range [a, stop) of offsets to look at: hashes of what its strings share and of all they span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:5]), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[5:])],
                ["k", "pos", "n", "a", "stop", "core", "whole"])

        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for row in zip(*batch.columns):
                h, k, pos, text, before, todo = (v.as_py() for v in row)
                if len(out[0]) >= ROWS:
                    yield made(out)
                    out = [[], [], [], [], [], [], []]
                after = len(text) - before
                for first, last, n in zip(todo[::3], todo[1::3], todo[2::3]):
                    for a in range(first, last, width):
                        stop = min(a + width, last)
                        lo, hi = max(a, LENGTH - after), min(stop - 1, before)  # offsets whose strings lie in the context
                        if lo > hi:
                            continue
                        core = text[before - a:before + LENGTH - stop + 1]
                        whole = text[before - hi:before + LENGTH - lo]
                        key = h.to_bytes(8, "big", signed=True) + bytes([a, stop])
                        row = (k, pos, n, a, stop, xxhash.xxh3_64_intdigest(key + core), xxhash.xxh3_64_intdigest(key + bytes([lo, hi]) + whole, 1))
                        for col, v in zip(out, row):
                            col.append(v)
            if out[0]:
                yield made(out)
    return run


def _sort(members: DataFrame, group: str) -> DataFrame:
    return (members.select(group, "k", "pos", "n", "text", "before").repartition(group).sortWithinPartitions(group, "k", "pos")
            .mapInArrow(_sorted_groups, "k binary, pos long, pairs array<int>"))


def _refine(contexts: DataFrame, large: int) -> DataFrame:
    """``k, pos, pairs`` for contexts (``h, k, pos, n, text, before``) of large groups, by falling ranges of offsets.

    Within a range, contexts that agree in all its strings are covered there, and one of them stands for the others from then on; those
    that share nothing of what all strings of the range have in common are done with.
    """
    todo = contexts.withColumn("todo", F.array(F.lit(0).cast("long"), F.lit(REACH + 1).cast("long"), F.col("n").cast("long")))
    found = pairs = None
    for width in WIDTHS:
        rows = settle(todo.select("h", "k", "pos", "text", "before", "todo").mapInArrow(
            _range_rows(width), "k binary, pos long, n long, a long, stop long, core long, whole long"), "ranges")
        kinds = settle(rows.groupBy("core", "whole", "a", "stop").agg(F.sum("n").alias("n"), F.min(F.struct("k", "pos")).alias("one")), "kinds")
        same = spread_join(rows.drop("n"), kinds.filter("n > 1").select("core", "whole", "n"), ["core", "whole"], "n").select("k", "pos", "a", "stop")
        found = same if found is None else found.unionByName(same)
        several = settle(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "several")
        left = settle(spread_join(kinds.filter("stop - a > 1"), several, ["core"], "members").select("core", "one.k", "one.pos", "a", "stop", "n", "members"), "left")
        small = contexts.drop("n").join(left.filter(F.col("members") <= large).select("core", "k", "pos", "n"), ["k", "pos"])
        pairs = _sort(small, "core") if pairs is None else pairs.unionByName(_sort(small, "core"))
        more = left.filter(F.col("members") > large).groupBy("k", "pos").agg(F.flatten(F.collect_list(F.array("a", "stop", "n"))).alias("todo"))
        todo = settle(contexts.join(more, ["k", "pos"]), "todo")
        if not todo.take(1):
            break
    # offsets a .. stop - 1 are covered: their strings span stop - 1 bytes before the anchor and LENGTH - a from it on, cut by the context
    ends = found.join(contexts.select("k", "pos", "before", F.length("text").alias("size")), ["k", "pos"])
    l = F.least(F.col("stop") - 1, F.col("before")).cast("int")  # noqa: E741
    r = F.least(F.lit(LENGTH) - F.col("a"), F.col("size") - F.col("before")).cast("int")
    return pairs.unionByName(ends.groupBy("k", "pos").agg(F.flatten(F.collect_list(F.array(l, r))).alias("pairs")))


# The whole -----------------------------------------------------------------------------------------------------------

def _data(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(_data(v)) for v in batch.column(1)], pa.binary())], ["doc_id", "k"])


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, with their digests: what a shuffle of all texts moves."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for value in batch.column(1):
            data = _data(value)
            for col, v in zip(out, (xxhash.xxh3_128_digest(data), len(data), hashlib.sha256(data).digest(), press.compress(data))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary(), pa.binary()))], ["k", "n_bytes", "sha", "z"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["h", "k", "pos", "n", "text", "before", "classes"])

    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for name, z, wanted in zip(*batch.columns):
            data, k = open_.decompress(z.as_py()), name.as_py()
            for w in wanted.as_py():
                if len(out[0]) >= ROWS:
                    yield made(out)
                    out = [[], [], [], [], [], [], []]
                p = w["pos"]
                for col, v in zip(out, (w["h"], k, p, w["n"], data[max(0, p - REACH):p + LENGTH], min(p, REACH), w["classes"])):
                    col.append(v)
        if out[0]:
            yield made(out)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, runs removed); spans are ranges that go."""
    out, last, removed = [], 0, 0
    runs = merged(spans)
    for a, b in runs:
        out.append(data[last:a])
        removed += b - a
        last = b
    out.append(data[last:])
    return b"".join(out), removed, len(runs)


def _results(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for z, spans in zip(batch.column(1), batch.column(2)):
                data = open_.decompress(z.as_py())
                ranges = []
                for s in spans.as_py() or ():
                    p, pairs = s["pos"], s["pairs"]
                    if s["runs"] is not None:
                        ranges += zip(s["runs"][::2], s["runs"][1::2])
                    elif pairs is None:  # the whole context
                        ranges.append((max(0, p - REACH), min(len(data), p + LENGTH)))
                    else:
                        ranges += [(p - l, p + r) for l, r in zip(pairs[::2], pairs[1::2])]  # noqa: E741
                kept, removed, count = cut(data, [(a, b) for a, b in ranges if b - a >= LENGTH])
                for col, v in zip(out, (removed, count, hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace") if with_text else None)):
                    col.append(v)
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:2]), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[3], pa.string())] * with_text, ["k", "removed", "spans", "kept_sha"] + ["kept"] * with_text)
    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, large: int = LARGE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining text) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = settle_by(rows.mapInArrow(_pressed, "k binary, n_bytes long, sha binary, z binary").groupBy("k").agg(
        F.first("z").alias("z"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"), F.count(F.lit(1)).alias("copies")), "texts", "k")
    marks = settle(texts.filter(F.col("n_bytes") >= LENGTH).select("k", "z", "copies").mapInArrow(_anchor_rows, ANCHORS), "marks")
    anchors = marks.filter("h is not null").select("h", "c", "k", "pos", "n")
    often = settle(anchors.groupBy("h").agg(F.sum("n").alias("weight")).filter("weight > 1"), "often")
    shared = settle(spread_join(anchors, often, ["h"], "weight").drop("weight"), "anchors")
    classes = settle(shared.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("k", "pos")).alias("one"))
                     .select("h", "c", "n", "one.k", "one.pos"), "classes")
    groups = settle(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.sum((F.col("n") == 1).cast("long")).alias("alone"))
                    .filter("classes > 1 and alone > 0").select("h", "classes"), "groups")
    wanted = (spread_join(classes, groups, ["h"], "classes").groupBy("k").agg(F.collect_list(F.struct("h", "pos", "n", "classes")).alias("wanted")))
    contexts = settle(texts.select("k", "z").join(wanted, "k").select("k", "z", "wanted").mapInArrow(
        _contexts, "h long, k binary, pos long, n long, text binary, before int, classes long"), "contexts")
    pairs = _sort(contexts.filter(F.col("classes") <= large), "h")
    crowded = contexts.filter(F.col("classes") > large).drop("classes")
    if crowded.take(1):
        pairs = pairs.unionByName(_refine(settle(crowded, "crowded"), large))
    repeated = classes.filter("n > 1").select("h", "c", F.col("n").alias("weight"))
    none = lambda t: F.lit(None).cast(t)
    whole = spread_join(shared, repeated, ["h", "c"], "weight").select("k", "pos", none("array<int>").alias("pairs"), none("array<long>").alias("runs"))
    own = marks.filter("h is null").select("k", "pos", none("array<int>").alias("pairs"), "runs")
    spans = (pairs.withColumn("runs", none("array<long>")).unionByName(whole).unionByName(own)
             .groupBy("k").agg(F.collect_list(F.struct("pos", "pairs", "runs")).alias("spans")))
    if with_text:
        touched = texts.select("k", "z").join(spans, "k", "left").select("k", "z", "spans")
    else:
        touched = texts.filter("copies = 1").select("k", "z").join(spans, "k").select("k", "z", "spans")
    extra = ", kept string" if with_text else ""
    changed = touched.mapInArrow(_results(with_text), f"k binary, removed long, spans long, kept_sha binary{extra}")
    # a text of several rows goes whole, if it has LENGTH bytes
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    figures = texts.select("k", "n_bytes", "sha", "copies").join(changed, "k", "left").select(
        "k", "n_bytes", "copies", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(gone, F.unhex(F.lit(hashlib.sha256().hexdigest()))).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        *([F.when(gone, "").otherwise(F.col("kept")).alias("kept")] if with_text else []))
    out = spread_join(rows.mapInArrow(_named, "doc_id long, k binary"), settle(figures, "figures"), ["k"], "copies")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
