"""SimHash near-dedup (operator 6): pivot distance tables.

Method. A text's fingerprint has 64 bits: each bit is the majority of that bit over the XXH64 hashes of its word shingles.
For many fixed reference fingerprints (pivots) the Hamming distance of every distinct fingerprint is computed once and goes with it; by
the triangle inequality two fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate of
that table. Pairs are discarded by their largest coordinate difference, and the survivors are verified on all 64 bits.

Distribution. Equal fingerprints are collapsed first, so a group of copies is one entry. For pairs to meet without
comparing all with all, each fingerprint goes to the fifteen quadruples of its six blocks of 10 or 11 bits: two fingerprints that differ in at
most two bits agree in at least four blocks. A bucket has 42 to 44 bits in common, so it holds no more than 2^22 fingerprints whatever the data; one
that is large even so is parted again by the bits that are still free (three parts, of which at least one agrees). Within a bucket rows are
ordered by their first pivot distance and only those within ``radius`` of each other meet. A bucket reports a forest of its verified links, not every pair, which
loses no link between components.

Forests depend on the order of rows, so buckets are put in full order: a task that runs again after an executor is lost reports the same links, and
tasks that have read the first report fit those that read the second.

Defined cases: null text counts as empty; texts without a word have fingerprint zero and link like any other; ties need no
rule as the component is named by its least id; repeated rows give repeated results; a null id takes part in linking but
never names a component unless it is alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import components, one_row_each, settle, spread_join, text_name

SEED, WORDS, RADIUS, PIVOTS, BLOCK_ROWS, LARGE = 42, 3, 2, 24, 1 << 16, 2048
#: First bits of the blocks, and the quadruples of blocks that fingerprints meet in.
EDGES = [0, 11, 22, 33, 44, 54, 64]
BLOCKS = list(combinations(range(6), 4))


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    hash_of = partial(xxhash.xxh64_intdigest, seed=SEED)
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_ROWS):
        h = np.fromiter(map(hash_of, shingles), np.uint64, min(BLOCK_ROWS, n - at))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, made by rule: hashes of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), seed=SEED) for i in range(n)], np.uint64)


def _distances(fps: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ to[None, :]).astype(np.int8)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the components of the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def fixed_bits(which: int) -> int:
    """Mask of the bits that a bucket of this quadruple has in common."""
    return sum((1 << EDGES[i + 1]) - (1 << EDGES[i]) for i in BLOCKS[which])


def links(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int = RADIUS, free: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links (as forests) among fingerprints that share a key. ``table``: their pivot distances; ``free``: mask of the bits a key leaves open."""
    order = np.argsort(keys, kind="stable")
    keys, fps, table = keys[order], fps[order], table[order]
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    small = np.repeat((sizes > 1) & (sizes <= LARGE), sizes)
    if small.any():
        yield from _within(keys[small], fps[small], table[small], radius)
    for s in np.flatnonzero(sizes > LARGE):
        part, rows = fps[bounds[s]:bounds[s + 1]], table[bounds[s]:bounds[s + 1]]
        bits = [i for i in range(64) if free >> i & 1]
        if len(bits) < 9:  # at most 256 different fingerprints are left then
            yield from _within(np.zeros(len(part), np.int64), part, rows, radius)
            continue
        for g in range(radius + 1):
            own = sum(1 << i for i in bits[g::radius + 1])
            yield from links(part & np.uint64(own), part, rows, radius, free & ~own)


def _within(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    first, n, found = table[:, 0].astype(np.int16), len(fps), []
    for d in range(1, n):
        near = np.flatnonzero((keys[d:] == keys[:-d]) & (first[d:] - first[:-d] <= radius))
        if not len(near):
            if not (keys[d:] == keys[:-d]).any():
                break
            continue
        survive = near[(np.abs(table[near + d].astype(np.int16) - table[near]).max(axis=1) <= radius)]
        close = survive[np.bitwise_count(fps[survive] ^ fps[survive + d]) <= radius]
        if len(close):
            found.append((close, close + d))
    if found:
        a, b = _forest(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        yield fps[a], fps[b]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(v.as_py() or "", words) for v in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct fingerprints with their pivot distances, a byte each."""
    refs = pivots()
    for batch in batches:
        rows = _distances(batch.column(0).to_numpy().view(np.uint64), refs).tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rows[i:i + PIVOTS] for i in range(0, len(rows), PIVOTS)], pa.binary())], ["fp", "least", "far"])


def bucket_keys(fps: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of each quadruple of blocks."""
    block = [(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(EDGES, EDGES[1:])]
    for k, which in enumerate(BLOCKS):
        key = np.full(len(fps), k, np.uint64)
        for i in which:
            key = (key << np.uint64(11)) | block[i]
        yield key.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key in bucket_keys(batch.column(0).to_numpy().view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "fp", "far"])


def _links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets."""
    key, fps = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
    table = np.frombuffer(b"".join(t.column("far").to_pylist()), np.int8).reshape(-1, PIVOTS)
    for which in np.unique(key >> 44):
        at = key >> 44 == which
        for a, b in links(key[at], fps[at], table[at], RADIUS, ((1 << 64) - 1) & ~fixed_bits(int(which))):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id``; links at RADIUS or fewer differing bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = settle(rows.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).mapInArrow(_tables, "fp long, least long, far binary"), "distinct")
    met = distinct.select("fp", "far").mapInArrow(_keys, "key long, fp long, far binary").repartition("key").sortWithinPartitions("key", "fp")
    roots = components(met.mapInArrow(lambda it: _by_key(it, "key", _links), "a long, b long"))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = settle(named.join(least, "root").select("fp", "component_id").join(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")), "fp"), "of")
    return spread_join(marked, of, ["fp"], "rows").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of shingle sets ------------------------------------------------------------------------------------------

#: Words of a set's fingerprint, its pivots, bands of least hashes and their length, and sizes: of sets that also meet by their first hashes, of crowds.
WIDE_WORDS, WIDE_PIVOTS, BANDS, IN_BAND, SMALL, CROWD = 4, 8, 20, 4, 20, 32
#: Bits: spread allowed beyond the expectation (five standard deviations), more of it for small sets, and the reach of a leader.
SPREAD, SMALL_SPREAD, REACH = 28, 24, 6
#: Members of a cluster in one block.
MEMBERS = 2048
ODD = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.default_rng(SEED + 1).integers(1 << 62, 1 << 63, IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    """XXH64 of the distinct word shingles, in order."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    hash_of = partial(xxhash.xxh64_intdigest, seed=SEED)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    return np.unique(np.fromiter(map(hash_of, shingles), np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE_WORDS x 64 bits of majority over a set of shingles."""
    salts = np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(h), 255):  # sums of 255 bits fit a byte
        x = h[at:at + 255, None] ^ salts[None, :]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).view(np.uint64)


def farthest(similarity: float) -> int:
    """Bits by which the fingerprints of sets of this Jaccard similarity may differ: the expectation, largest for sets of one size, and SPREAD."""
    return int(64 * WIDE_WORDS * np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi) + SPREAD


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of IN_BAND least hashes of a set: a pair at 0.8 shares none of them once in 38,000 times."""
    least = np.full(len(ODD), ~np.uint64(0))
    for at in range(0, len(h), 512):
        x = h[at:at + 512, None] * ODD[None, :]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    keys = (least.reshape(BANDS, IN_BAND) * MIX[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * MIX[0]).view(np.int64)


def _differing(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ one).sum(axis=-1, dtype=np.int16)


def near_pairs(keys: np.ndarray, fps: np.ndarray, far: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of rows with one key that differ in at most the larger ``reach``, as forests. Keys are in order.

    A pair whose distances to the pivots (``far``) differ by more is discarded, the others are verified on all bits.
    """
    n, a, b = len(keys), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, n):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            break
        most = np.maximum(reach[i], reach[i + d])
        ok = np.flatnonzero(np.abs(far[i] - far[i + d]).max(axis=1) <= most)
        i, most = i[ok], most[ok]
        i = i[_differing(fps[i], fps[i + d]) <= most]
        a.append(i)
        b.append(i + d)
    return _forest(n, np.concatenate(a), np.concatenate(b))


def leaders(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the place of its leader, at most REACH bits away; leaders are their own.

    Small sets follow small ones only, so that a leader is allowed the spread that its followers need.
    """
    out, rest = np.empty(len(fps), np.int64), np.arange(len(fps))
    while len(rest):
        own = (_differing(fps[rest], fps[rest[0]]) <= REACH) & ((n[rest] <= SMALL) == (n[rest[0]] <= SMALL))
        out[rest[own]] = rest[0]
        rest = rest[~own]
    return out


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
    far = np.frombuffer(b"".join(t.column("far").to_pylist()), np.uint8).reshape(-1, WIDE_PIVOTS).astype(np.int16)
    return t.column("key").to_numpy(), t.column("node").to_numpy(), fps, far, t.column("n").to_numpy()


def _crowds(keys: np.ndarray) -> Iterator[np.ndarray]:
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for k in np.flatnonzero(np.diff(bounds) > CROWD):
        yield np.arange(bounds[k], bounds[k + 1])


def _link_batch(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


MET = "key long, node long, fp binary, far binary, n long, leader long"


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of a crowd that shares a key in one batch only the leaders go on, and the others say whom they follow."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).sort_by("key").combine_chunks()
        key, node, fps, _, n = _columns(t)
        follow = np.arange(len(key))
        for crowd in _crowds(key):
            follow[crowd] = crowd[leaders(fps[crowd], n[crowd])]
        out = t.append_column("leader", pa.array(node[follow], pa.int64(), mask=follow == np.arange(len(key))))
        yield from out.to_batches()


def _loose(similarity: float):
    """Links of whole keys: pairs of rows, which may be leaders, so that all pairs of followers within :func:`farthest` are joined."""
    most = farthest(similarity)

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key, node, fps, far, n = _columns(t)
        reach = np.where(n <= SMALL, most + SMALL_SPREAD, most).astype(np.int16) + 2 * REACH
        few = np.ones(len(key), bool)
        for crowd in _crowds(key):
            few[crowd] = False
            lead = leaders(fps[crowd], n[crowd])
            moved = np.flatnonzero(lead != np.arange(len(crowd)))
            yield _link_batch(node[crowd], moved, lead[moved])
            own = crowd[np.unique(lead)]
            yield _link_batch(node[own], *near_pairs(np.zeros(len(own), np.int64), fps[own], far[own], reach[own] + 2 * REACH))
        few = np.flatnonzero(few)
        if len(few):
            yield _link_batch(node[few], *near_pairs(key[few], fps[few], far[few], reach[few]))
    return run


def jaccard_links(sets: list[np.ndarray], others: list[np.ndarray], similarity: float) -> list[bool]:
    """Whether sets of hashes (in order) have this Jaccard similarity, pair by pair."""
    out = []
    for x, y in zip(sets, others):
        small, large = sorted((len(x), len(y)))
        both = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large - 1e-9 else 0
        out.append(both + 1e-9 >= similarity * (small + large - both))
    return out


def true_links(cluster: np.ndarray, sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets of one cluster whose exact Jaccard similarity is ``similarity`` or more, as forests. Clusters are in order.

    A set that has been reached is not compared with others that have been, which loses no link between components. Only sets whose sizes and
    fingerprints allow the similarity (:func:`farthest`) are compared.
    """
    most = farthest(similarity)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    bounds = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        m = hi - lo
        if m < 2:
            continue
        size = np.array([len(s) for s in sets[lo:hi]])
        kinds, flat = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
        ends = np.r_[0, np.cumsum(size)]
        mark, rest = np.zeros(len(kinds), bool), np.arange(m)
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                at = todo.pop()
                own = flat[ends[at]:ends[at + 1]]
                near = rest[np.minimum(size[rest], size[at]) >= similarity * np.maximum(size[rest], size[at]) - 1e-9]
                spread = np.where(np.minimum(size[near], size[at]) <= SMALL, SMALL_SPREAD, 0)
                near = near[_differing(fps[lo + near], fps[lo + at]) <= most + spread]
                mark[own] = True
                both = np.array([np.count_nonzero(mark[flat[ends[r]:ends[r + 1]]]) for r in near], np.int64)
                mark[own] = False
                hit = near[both + 1e-9 >= similarity * (size[near] + size[at] - both)] if len(near) else near
                a.append(np.full(len(hit), lo + at))
                b.append(lo + hit)
                todo += hit.tolist()
                rest = np.setdiff1d(rest, hit, assume_unique=True)
    return np.concatenate(a), np.concatenate(b)


def _by_key(batches: Iterator[pa.RecordBatch], key: str, report) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by key; a key that may go on in the next batch waits for it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield from report(held.slice(0, end))
            held = held.slice(end)
    if held is not None:
        yield from report(held)


def _named(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id, sha, root``: one row a document with the name of its component of similar sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("sha"), F.col("text").cast("string").alias("text"))
    refs = pivots(WIDE_PIVOTS * WIDE_WORDS).reshape(WIDE_PIVOTS, WIDE_WORDS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(v.as_py() or "", words) for v in batch.column(2)]
            fps = [wide_fingerprint(s) for s in sets]
            far = [np.minimum(_differing(refs, f), 255).astype(np.uint8).tobytes() for f in fps]
            keys = []
            for s in sets:  # small sets of this similarity share one of the first hashes in any case
                first = s[:len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1].view(np.int64) if len(s) <= SMALL else s[:0].view(np.int64)
                keys.append(np.concatenate([band_keys(s), first]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(far, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], pa.uint64()).view(pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "sha", "fp", "far", "n", "node", "keys"])

    marked = settle(rows.mapInArrow(mark, "doc_id long, sha string, fp binary, far binary, n long, node long, keys array<long>"), "wide")
    entries = marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "far", "n", "keys")))
    met = settle(entries.select(F.explode("keys").alias("key"), "node", "fp", "far", "n").mapInArrow(_thin, MET), "met")
    firm = met.filter("leader is null").drop("leader").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda it: _by_key(it, "key", _loose(similarity)), "a long, b long")
    clusters = components(firm.unionByName(met.filter("leader is not null").select(F.col("node").alias("a"), F.col("leader").alias("b"))))

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([shingle_set(v.as_py() or "", words).tobytes() for v in batch.column(3)], pa.binary())], ["node", "root", "fp", "set"])

    def with_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(jaccard_links(x, y, similarity), pa.bool_())], ["node", "root", "linked"])

    def exact(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
        yield _link_batch(node, *true_links(t.column("pair").to_numpy(), [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()], fps, similarity))

    # one document stands for each set of a cluster; its set is made again from its text
    pick = (marked.join(clusters, "node").groupBy("node", "root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "fp")).alias("w"))
            .select("node", "root", "w.fp", F.col("w.doc_id").alias("p_id"), F.col("w.sha").alias("p_sha")))
    texts = (rows.join(pick, rows["doc_id"].eqNullSafe(pick["p_id"]) & (rows["sha"] == pick["p_sha"])).select("node", "root", "fp", "text"))
    sets = settle(texts.mapInArrow(with_set, "node long, root long, fp binary, set binary"), "sets")
    # most clusters, the large ones of near copies before all, are done once every member has been held against the centre
    centres = sets.filter("node = root").select(F.col("root").alias("c_root"), F.col("set").alias("centre"))
    stars = settle(sets.join(centres, F.col("root") == F.col("c_root")).select("node", "root", "set", "centre").mapInArrow(with_centre, "node long, root long, linked boolean"), "stars")
    open_ = settle(stars.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.min("linked").alias("done")).filter("not done").select("root", F.ceil(F.col("m") / MEMBERS).alias("blocks")), "open")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rest = (sets.join(open_, "root").withColumn("own", own).withColumn("other", other)
            .select("node", "fp", "set", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("pair"))
            .repartition("pair").sortWithinPartitions("pair", "node").mapInArrow(lambda it: _by_key(it, "pair", exact), "a long, b long"))
    roots = components(rest.unionByName(stars.filter("linked").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return settle(marked.select("doc_id", "sha", "node").join(roots, "node", "left").select("doc_id", "sha", F.coalesce("root", "node").alias("root")), "named")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: documents joined by links of Jaccard similarity ``similarity`` or more of their sets of word shingles.

    Fingerprints of 256 bits over the sets, with their distances to pivots, only choose candidates. Entries meet by BANDS keys of IN_BAND least hashes each,
    whatever the size of the corpus (a pair at 0.8 shares no key once in 38,000 times, one above it more rarely); sets of up to SMALL shingles also meet by the first of
    their hashes, which is complete. In a crowd that shares a key only leaders are compared, and by the triangle inequality wide enough
    that no pair of followers is lost. Candidates form clusters. Each member is held against its cluster's centre by a join; clusters that this leaves
    open are compared set by set, by a task for each pair of blocks of at most about MEMBERS members. Links are exact: no pair below the threshold is linked.
    """
    named = _named(docs, words, similarity)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of every group of similar ones, with its own columns: the one with the least id, of several the one with the least text hash."""
    of = _named(docs, words, similarity).groupBy("root", "doc_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "n")).alias("w"))
    return one_row_each(docs, settle(first.select("w.doc_id", "w.sha", "w.n"), "first"))
