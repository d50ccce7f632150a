"""Language ID (operator 10): prediction by partial matching.

Method. For each language a context tree over all 256 bytes of lower-cased texts holds how often each byte followed each
context of up to ORDER bytes. A byte that was seen in the longest context known is coded with its share there; one that was not costs an
escape, whose probability is the number of different bytes seen there over that number plus the count (method C), and is coded in the next shorter
context, below order 0 as one of 256. A context that was never seen costs nothing and is left for the next shorter one. The statistics are frozen
after training, so a text's code length in a language is an exact sum over the bytes of the whole text, and the shortest wins.

The trees are sparse: for each order a hash table from the byte sequences that were seen to their code lengths in each of up to GROUP languages, and one
from contexts to escapes. Memory follows the different sequences of the bounded sample, the alphabet is the same for any number
of languages, and a further group of languages costs one more pass over the text.

Training takes whole documents with non-null language and text outside the held-out fold, at most SAMPLE_DOCS of each
language in expectation, chosen by a hash of their id and text; ``lang``, ``source`` and ``doc_id`` never enter a prediction.
Counting is distributed; the driver receives only sums by language and byte sequence of that bounded sample.

Defined cases: null text, or one without a letter, gives ``und`` with score 0; ties go to the lesser language value; with
no trainable rows everything is ``und``; a null id is not held out and not learned from; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, SAMPLE_DOCS, FOLDS, GROUP, BLOCK = 4, 1500, 5, 8, 1 << 17
#: Bits by which the code of a text may be longer than its bytes: a word or two that were never seen tell nothing against a language.
SPARE = 64
PAD = b"\n" * ORDER


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Model(NamedTuple):
    """Sorted language values and, for each, the counts of byte sequences of length ORDER + 1 (as one integer each)."""

    langs: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            b = np.frombuffer(PAD + folded(text.as_py()), np.uint8).astype(np.int64)
            g = b[ORDER:].copy()
            for k in range(1, ORDER + 1):
                g |= b[ORDER - k:len(b) - k] << (8 * k)
            sums.setdefault(lang, []).append(g)
        for lang, parts in sums.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Context statistics of each language over the training fold."""
    fold = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    sizes = {r["lang"]: r["n"] for r in fold.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [], [])
    # the share of a language's rows to take; rows whose hash falls under it are the sample
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    picked = fold.filter(draw < share[F.col("lang")]).select("lang", "text")
    sums = picked.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    lang, gram, n = (got.column(i) for i in range(3))
    langs = sorted(set(lang.to_pylist()) | set(sizes))
    code = np.asarray(lang.to_pylist(), dtype=object)
    gram, n = gram.to_numpy(), n.to_numpy()
    order = np.argsort(gram, kind="stable")
    code, gram, n = code[order], gram[order], n[order]
    return Model(langs, [gram[code == x] for x in langs], [n[code == x] for x in langs])


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """Rows of distinct keys: a hash table with open addressing, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), _slots(keys, self.bits)
        while len(todo):
            free = np.flatnonzero(self.row[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.row[at[won]] = keys[todo[won]], todo[won]
            lost = np.delete(np.arange(len(todo)), won)
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = _slots(keys, self.bits)
        row = self.row[at]
        todo = np.flatnonzero((row >= 0) & (self.key[at] != keys))
        while len(todo):
            step = (at[todo] + 1) & ((1 << self.bits) - 1)
            at[todo] = step
            row[todo] = self.row[step]
            todo = todo[(row[todo] >= 0) & (self.key[step] != keys[todo])]
        return row


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Trees:
    """Context trees of up to GROUP languages: code lengths by byte sequence and escapes by context, for each order."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        k = len(grams)
        self.base = np.full((256, k), 8.0, np.float32)
        self.grams: list[tuple[Lookup, np.ndarray]] = []
        self.escapes: list[tuple[Lookup, np.ndarray]] = []
        below_keys, below = np.arange(256, dtype=np.uint64), self.base
        for order in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            own = [_sums(g.astype(np.uint64) & mask, n) for g, n in zip(grams, counts)]
            keys = np.unique(np.concatenate([x for x, _ in own])) if order else np.arange(256, dtype=np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            cost = below[np.searchsorted(below_keys, keys & (mask >> np.uint64(8)))] if order else np.full((256, k), 8.0, np.float32)
            escape = np.zeros((len(contexts), k), np.float32)
            for i, (x, n) in enumerate(own):
                if not len(x):
                    continue
                at = np.searchsorted(contexts, x >> np.uint64(8))
                seen, kinds = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
                known = kinds > 0
                escape[known, i] = np.log2((seen + kinds)[known] / kinds[known])
                cost[:, i] += escape[np.searchsorted(contexts, keys >> np.uint64(8)), i]
                cost[np.searchsorted(keys, x), i] = np.log2((seen + kinds)[at] / n)
            if order:
                self.grams.append((Lookup(keys), cost))
                self.escapes.append((Lookup(contexts), escape))
            else:
                self.base = cost
            below_keys, below = keys, cost

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each sequence of ORDER + 1 bytes, one column a language."""
        out, todo = np.zeros((len(grams), self.base.shape[1]), np.float32), np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            keys = grams[todo] & np.uint64((1 << (8 * (order + 1))) - 1)
            (known, cost), (contexts, escape) = self.grams[order - 1], self.escapes[order - 1]
            row = known.find(keys)
            hit = row >= 0
            out[todo[hit]] += cost[row[hit]]
            todo, keys = todo[~hit], keys[~hit]
            if not len(todo):
                return out
            row = contexts.find(keys >> np.uint64(8))
            hit = row >= 0
            out[todo[hit]] += escape[row[hit]]
        out[todo] += self.base[(grams[todo] & np.uint64(255)).astype(np.int64)]
        return out


class Tables:
    """The context trees of all languages of a model."""

    def __init__(self, model: Model):
        self.n = len(model.langs)
        self.groups = [Trees(model.grams[i:i + GROUP], model.counts[i:i + GROUP]) for i in range(0, self.n, GROUP)]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths in bits of whole texts, a row a text and a column a language. Texts are read side by side, a block of bytes a time."""
        out = np.zeros((len(texts), self.n))
        parts: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            data = PAD + text
            for at in range(ORDER, len(data), BLOCK):
                parts.append((i, data[at - ORDER:at + BLOCK]))
                size += len(parts[-1][1])
                if size >= BLOCK:
                    self._add(out, parts)
                    parts, size = [], 0
        if parts:
            self._add(out, parts)
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, bytes]]) -> None:
        b = np.frombuffer(b"".join(p for _, p in parts), np.uint8).astype(np.uint64)
        g = b[ORDER:].copy()
        for k in range(1, ORDER + 1):
            g |= b[ORDER - k:len(b) - k] << np.uint64(8 * k)
        starts = np.cumsum([0, *(len(p) for _, p in parts[:-1])])
        keep = np.ones(len(g), bool)
        for k in range(ORDER):  # sequences that end in the lead of the next part
            at = starts[1:] - ORDER + k
            keep[at] = False
        g, first = g[keep], starts - ORDER * np.arange(len(parts))
        which = np.array([i for i, _ in parts])
        for j, trees in enumerate(self.groups):
            sums = np.add.reduceat(trees.bits(g), first, axis=0, dtype=np.float64)
            np.add.at(out[:, j * GROUP:(j + 1) * GROUP], which, sums)


_held: dict[str, Tables] = {}


def _tables(key: str, model: Model) -> Tables:
    """The tables of a model, unrolled once in each worker process and kept for its next tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = Tables(model)
    return _held[key]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def verdicts(tables: Tables | None, langs: list[str], column: pa.Array) -> list[tuple[str, float, float | None, int]]:
    """(language, score, bits a byte, bytes) of each text; ``und`` where there is nothing to tell from."""
    out: list[tuple[str, float, float | None, int]] = [("und", 0.0, None, 0)] * len(column)
    texts = [(i, folded(t)) for i, v in enumerate(column) if tables and (t := v.as_py()) and has_letter(t)]
    if texts:
        for (i, text), bits in zip(texts, tables.lengths([t for _, t in texts])):
            best = int(np.argmin(bits))
            out[i] = (langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(text)), len(text))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every whole text. A map-only plan: no shuffle.

    The score is the posterior of the prediction under equal priors. The model is broadcast: byte-sequence counts of the
    bounded sample, some MB whatever the size of the data.
    """
    shipped, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shipped.value.langs
        tables = _tables(key, shipped.value) if langs else None
        for batch in batches:
            said = verdicts(tables, langs, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([v[i] for v in said], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return predict(docs, train(docs, sample_docs))


def accepted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: list[str] | None = None, least_score: float = 0.5, most_bits: float = 8.0) -> DataFrame:
    """The documents that are text of a wanted language (None: any that was learned), with their own columns.

    Rejected: ``und``, a score under ``least_score``, and a code that is longer by SPARE bits than ``most_bits`` a byte, which is no text of that
    language. A null ``lang`` of a document that stays becomes the prediction. One map over the rows, no join.
    """
    model = train(docs, sample_docs)
    if not model.langs:
        return docs.limit(0)
    shipped, key, at, label = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, shipped.value)
        for batch in batches:
            said = verdicts(tables, shipped.value.langs, batch.column(at))
            stays = [p != "und" and (languages is None or p in languages) and s >= least_score and (r - most_bits) * n < SPARE for p, s, r, n in said]
            told = pa.array([p if v is None else v for v, (p, *_) in zip(batch.column(label).to_pylist(), said)], batch.schema.field(label).type)
            columns = [told if i == label else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
