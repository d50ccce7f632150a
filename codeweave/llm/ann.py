"""Approximate nearest neighbours (operator 2): inverted file with product-quantised residuals.

Method. Vectors are scaled to length one. Coarse centroids (spherical k-means) part the vectors into cells; a
vector's residual to its centroid is cut into subvectors, each replaced by the nearest of 256 (or fewer) codewords. A
query looks into its nearest cells; an asymmetric table of inner products between its subvectors and all codewords
gives every entry's approximate cosine by lookups. Every entry keeps the length of what its codes leave out, which bounds how far its
exact cosine can lie from the approximate one. A query's nearest cells give it a mark, the exact cosine of the last of its best; in all
further cells only entries whose upper bound reaches that mark are reranked, by the exact cosine of the original vectors in double precision. So codes
discard, and the answer over the probed cells is exact, ties included, with no limit on the entries that are reranked.

Training uses a bounded sample, chosen by a hash of the vector: SAMPLE vectors in expectation, or PER_CELL for each cell if that is more, at most MOST. Every row is
indexed. The number of cells follows the square root of the number of rows up to MOST / PER_CELL cells (1.7e10 rows); many cells are trained in two levels. How many cells a query looks
into is measured, not assumed: on the sample, against brute force, the least number whose cells hold TARGET of all true
neighbours is taken. Clustered vectors need few cells; directionless ones need many, and get them.

Distribution. Equal vectors are collapsed to one entry with the few least ids that any answer can need. Index entries
and queries meet by cell in blocks of entries, so a crowded cell is dealt out over many tasks; each block returns its few
best for each query, none where nothing reaches the mark, and a last aggregation merges them. Entries keep their vectors, as bytes of the precision they came in: with one query in fifty rows,
fetching the vectors of a shortlist of R for each would move the table R / 50 times.

Defined cases: vectors that are null, zero, of another length than most, or with null or
non-finite components take no part, neither as query nor as candidate; components of any finite size are scaled by a power of two before they are squared;
equal scores go to the lesser id; rows that repeat an id and its vector are one candidate, other vectors of one id are candidates of their own, except those of the query's own
id; queries with fewer candidates get them all; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import settle

SAMPLE, PARTS, CODEWORDS, ROUNDS, FIRST, TARGET, TRIALS = 20_000, 16, 256, 12, 200, 0.97, 256
#: Sampled vectors a cell, the largest sample, and cells that are trained at once.
PER_CELL, MOST, FLAT = 8, 1 << 20, 2048
#: Room for rounding in comparisons of a bound with an exact cosine.
ROUNDING = 1e-9
#: Index entries and queries that meet in one task, at most on average.
BLOCK, QUERY_BLOCK = 4096, 32_768
#: Components of the pairs of queries and entries that are held at once.
PAIRS = 1 << 22


class Index(NamedTuple):
    coarse: np.ndarray    # cells x dim
    words: np.ndarray     # parts x codewords x (dim / parts)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = assign(x, c, spherical)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, weights=x[:, j], minlength=k)
        n = np.bincount(near, minlength=k)
        c[n > 0] /= n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
        if spherical:
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def assign(x: np.ndarray, c: np.ndarray, spherical: bool, rows: int = 2048) -> np.ndarray:
    off = 0 if spherical else (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i:i + rows] @ c.T - off, axis=1) for i in range(0, len(x), rows)] or [np.empty(0, np.int64)])


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k spherical centroids; more than FLAT in two levels: a few, and in each one's part its share of them."""
    if k <= FLAT:
        return kmeans(x, k, rng, True)
    top = kmeans(x[rng.choice(len(x), min(len(x), SAMPLE), replace=False)], int(k ** 0.5), rng, True)
    near = assign(x, top, True)
    parts = [x[near == i] for i in range(len(top))]
    return np.concatenate([centroids(p, max(1, min(len(p), round(k * len(p) / len(x)))), rng) for p in parts if len(p)])


def parts_of(dim: int) -> int:
    return next(p for p in range(min(PARTS, dim), 0, -1) if dim % p == 0)


def fit(x: np.ndarray, cells: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    x = unit(x.astype(np.float64))
    coarse = centroids(x, min(cells, len(x)), rng)
    some = x[rng.choice(len(x), min(len(x), SAMPLE), replace=False)]
    rest = some - coarse[assign(some, coarse, True)]
    p = parts_of(x.shape[1])
    k = min(CODEWORDS, len(rest))
    return Index(coarse, np.stack([kmeans(s, k, rng, False) for s in np.split(rest, p, axis=1)]))


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and codes of vectors of length one."""
    cell = assign(x, index.coarse, True)
    rest = np.split(x - index.coarse[cell], len(index.words), axis=1)
    return cell, np.stack([assign(s, w, False) for s, w in zip(rest, index.words)], axis=1).astype(np.uint8)


def left_out(index: Index, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of what cells and codes leave out of vectors of length one."""
    said = index.coarse[cell] + np.concatenate([w[codes[:, p]] for p, w in enumerate(index.words)], axis=1)
    return np.linalg.norm(x - said, axis=1)


def best_of(about: np.ndarray, slack: np.ndarray, exact, k: int, mark: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best entries that reach ``mark``, with all that tie with the last. ``exact`` gives the exact scores of places.

    The FIRST entries by approximate score only raise the mark; whatever its bound lets reach the mark is scored exactly too.
    """
    most = about + slack + ROUNDING
    reach = np.flatnonzero(most >= mark)
    if len(reach) > max(FIRST, k):
        first = reach[np.argpartition(-about[reach], max(FIRST, k))[:max(FIRST, k)]]
        reach = reach[most[reach] >= np.partition(exact(first), -k)[-k]]
    score = exact(reach)
    top = np.partition(score, -k)[-k] if len(score) > k else -np.inf
    return reach[score >= top], score[score >= top]


def best_of_all(about: np.ndarray, slack: np.ndarray, near, exact, k: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries, places and exact scores of what :func:`best_of` finds for every query, a row of ``about`` each.

    ``near`` gives the scores of a query's places up to ROUNDING, from their vectors, and ``exact`` the exact scores of pairs. What reaches a mark by its bound but not by its exact score is left out, so a block far from a query's best says nothing.
    """
    reach = about + slack + ROUNDING >= marks[:, None]
    many = np.flatnonzero(np.count_nonzero(reach, axis=1) > max(FIRST, k))
    reach[many] = False
    i, at = np.nonzero(reach)
    ends = np.searchsorted(i, np.arange(len(marks) + 1)).tolist()
    close = np.concatenate([near(m, at[a:b]) for m, (a, b) in enumerate(zip(ends, ends[1:]))]) >= marks[i] - ROUNDING
    i, at = i[close], at[close]
    score = exact(i, at)
    order = np.lexsort((-score, i))
    i, at, score = i[order], at[order], score[order]
    start, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    best = score >= score[np.minimum(start + k, end) - 1]
    found = [(i[best], at[best], score[best])]
    for m in many:
        places, scores = best_of(about[m], slack, lambda at: exact(np.full(len(at), m), at), k, marks[m])  # noqa: B023
        found.append((np.full(len(places), m), places, scores))
    i, at, score = (np.concatenate(c) for c in zip(*found))
    return i[score >= marks[i]], at[score >= marks[i]], score[score >= marks[i]]


def probes_for(index: Index, x: np.ndarray, k: int, target: float = TARGET) -> int:
    """Cells to look into so that they hold ``target`` of the true k nearest among the sample ``x``."""
    x = unit(x.astype(np.float64))
    asked = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return len(index.coarse)
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ index.coarse.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], assign(x, index.coarse, True)[true]]
    return int(np.quantile(place, target, method="higher")) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _valid(v):
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def nearest(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every row for which ``is_query`` (a Column on ``vec_id``) holds."""
    spark = table.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    width = np.float32 if table.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    blobs = lambda x: pa.array([r.tobytes() for r in x.astype(width)], pa.binary())
    rows = (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & _valid(F.col("v"))))
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], out_schema)
    dim, n = shape[0]["dim"], shape[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    # equal vectors become one entry with the k + 1 least ids: no answer needs more of them; two levels bound every list
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    entries = settle(salted.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.xxhash64("v").alias("entry"))
                     .select("entry", "v", "ids"), "vectors")
    kinds = entries.count()
    wanted = min(MOST, max(SAMPLE, PER_CELL * round(kinds ** 0.5)))
    sample = entries.filter(F.pmod(F.col("entry"), F.lit(1 << 40)) <= int(min(1.0, wanted / kinds) * (1 << 40))).select("v").toArrow()
    train = _matrix(sample.column("v").combine_chunks(), dim)
    cells = int(max(1, min(len(train) // PER_CELL or 1, round(kinds ** 0.5))))
    index = fit(train, cells)
    cells = len(index.coarse)
    probes = probes_for(index, train, k)
    shipped = spark.sparkContext.broadcast(index)  # cells x dim and parts x 256 x dim / parts doubles

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = _matrix(batch.column(1), dim)
                x = unit(raw)
                cell, codes = encode(shipped.value, x)
                slack = left_out(shipped.value, x, cell, codes)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(slack), batch.column(0), blobs(raw), batch.column(2)],
                                                 ["cell", "codes", "slack", "entry", "x", "ids"])

    listed = settle(entries.mapInArrow(index_rows, "cell int, codes binary, slack double, entry long, x binary, ids array<long>"), "inverted")
    sizes = listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row a cell, and cells grow as a square root
    held = np.zeros(cells, np.int64)
    held[sizes["cell"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
    enough = min(int(held.sum()), 10 * (k + 1))
    blocks = spark.createDataFrame([(int(c), int(-(-held[c] // BLOCK))) for c in np.flatnonzero(held)], "cell int, blocks int")
    dealt = (listed.join(F.broadcast(blocks), "cell")  # bounded by the number of cells
             .withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).drop("blocks"))
    asked = settle(rows.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v"), "asked")
    kinds_asked = settle(asked.select("v").distinct().select(F.xxhash64("v", F.lit(1)).alias("query"), "v"), "queries")
    sets = -(-max(1, kinds_asked.count()) * probes // (cells * QUERY_BLOCK))
    if sets > 1:
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    else:
        dealt = dealt.withColumn("part", F.lit(0))

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column(1), dim)
            near = np.argsort(-(unit(raw) @ shipped.value.coarse.T), axis=1, kind="stable")
            # at least ``probes`` cells, and more where those hold too few entries to answer from; the nearest that hold enough set the mark
            early = np.cumsum(held[near], axis=1) - held[near] < enough
            at, place = np.nonzero((np.arange(cells) < probes)[None, :] | early)
            yield pa.RecordBatch.from_arrays([pa.array(near[at, place].astype(np.int32)), *(c.take(pa.array(at)) for c in (batch.column(0), blobs(raw), batch.column(2))), pa.array(early[at, place])],
                                             ["cell", "query", "qv", "mark", "early"])

    def probed(marked: DataFrame, early: bool) -> DataFrame:
        return (marked.select("query", "v", "mark").mapInArrow(probe_rows, "cell int, query long, qv binary, mark double, early boolean").filter(F.col("early") == early)
                .join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "early")
                .withColumn("part", F.pmod(F.xxhash64("query"), F.lit(sets)).cast("int")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": np.empty(0, np.int64), "best": np.empty(0, object)})
        ix: Index = shipped.value
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        x = scaled(np.frombuffer(b"".join(left["x"]), width).astype(np.float64).reshape(len(left), dim))
        norms = np.sqrt((x * x).sum(axis=1))
        ux = x / norms[:, None]
        ids, slack = left["ids"].to_numpy(), left["slack"].to_numpy()
        coarse = ix.coarse[int(left["cell"].iloc[0])]
        queries, best = [], []
        name, marks = right["query"].to_numpy(), right["mark"].to_numpy()
        asked_x = scaled(np.frombuffer(b"".join(right["qv"]), width).astype(np.float64).reshape(len(right), dim))
        lengths = np.sqrt((asked_x * asked_x).sum(axis=1))
        step = max(1, min(512, PAIRS // dim // len(left)))
        for lo in range(0, len(right), step):
            q, length = asked_x[lo:lo + step], lengths[lo:lo + step]
            own = q / length[:, None]
            tables = np.matmul(own.reshape(len(q), len(ix.words), -1).transpose(1, 0, 2), ix.words.transpose(0, 2, 1))
            about = np.repeat((own @ coarse)[:, None], len(left), axis=1)
            for table, code in zip(tables, codes.T):
                about += table[:, code]
            near = lambda m, at: ux[at] @ own[m]  # noqa: B023, E731
            exact = lambda i, at: (x[at] * q[i]).sum(axis=1) / (norms[at] * length[i])  # noqa: B023, E731
            found: dict[int, list[tuple[float, int]]] = {}
            for i, c, score in zip(*(v.tolist() for v in best_of_all(about, slack, near, exact, k + 1, marks[lo:lo + step]))):
                found.setdefault(i, []).extend((-score, int(e)) for e in ids[c])
            for i, some in found.items():
                queries.append(name[lo + i])
                best.append([{"minus": minus, "vec_id": e} for minus, e in sorted(some)[:k + 1]])
        return pd.DataFrame({"query": np.array(queries, np.int64), "best": pd.Series(best, dtype=object)})

    def meet(asking: DataFrame) -> DataFrame:
        return (dealt.groupBy("cell", "block", "part").cogroup(asking.groupBy("cell", "block", "part"))
                .applyInPandas(search, "query long, best array<struct<minus double, vec_id long>>"))

    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best")
    nearby = settle(meet(probed(kinds_asked.withColumn("mark", F.lit(float("-inf"))), True)).groupBy("query").agg(best), "nearby")
    # the own row of a query is among its k + 1 best
    marked = kinds_asked.join(nearby, "query").withColumn("mark", F.when(F.size("best") > k, -F.get("best", F.lit(k))["minus"]).otherwise(float("-inf")))
    found = nearby.unionByName(meet(probed(settle(marked.drop("best"), "marked"), False)))
    merged = found.groupBy("query").agg(best).join(kinds_asked, "query").select("v", "best")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (asked.join(merged, "v").select("query_id", F.posexplode(own).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score")))
