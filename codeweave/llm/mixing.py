"""Mixing sources to target weights (operator 3): soft-membership mixing.

Method. A classifier learned from the labelled table predicts, for every document, the posterior of each domain (toxic,
good, poor). The expected tokens of a domain are then sums of posterior x tokens x rate, and nonnegative rates are fitted
by projected-gradient least squares so that these totals match the target weights, with a slight pull to rate 1.

Posteriors are given in steps of 1 / GRID. By symmetry documents with one posterior vector have one rate, so after one
distributed aggregation of tokens by posterior the gradient runs over a table whose size is bounded by the grid and not by the
corpus; every iteration is one distributed sum over it (until no share moves by SETTLED of the total), and the state that goes round is one number a domain. The rates
follow from the list of those residuals, so any task can be repeated.

The classifier is a softmax regression over the presence of words and word stems (the WORDS of most information) and text-shape figures, fitted
on at most SAMPLE labelled documents in expectation, chosen by a hash of their id, one row an id (the bound is a documented parameter). Words are counted
and chosen by the cluster; the driver gets at most WORDS places and a few figures a document, however long it is.
Posteriors, totals, rates and copies cover all documents.

The total is chosen so that no domain with a positive weight has to shrink: rarer domains are repeated instead. Copies: the rate, rounded up or down by a
hash of the id so that the expectation is the rate. With ``least_one``, the default, rates of one half and more give at least one copy and smaller ones
none, so that no document is lost by chance; :func:`totals` says what that moves. A fit that has not settled after ROUNDS steps is an error.

Defined cases: null text counts as empty (no words, zero tokens); with fewer than two labelled domains every rate is 1;
several labels of one document: toxic if any says so, good only if all do; several texts of one labelled id: one of them, by its hash; null labels are left out; a null id is hashed like
any other; repeated rows are treated alike; an empty table gives an empty result; other columns pass through ``apply_mix``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import settle

DOMAINS = ["toxic", "good", "poor"]
#: Target weights of the domains; they are scaled to sum to one.
TARGETS = {"toxic": 0.0, "good": 0.85, "poor": 0.15}
SAMPLE, WORDS, STEM, GRID, PULL, ROUNDS, STEPS, RIDGE, SETTLED = 4000, 1500, 5, 200, 1e-3, 400, 500, 0.02, 2e-5
_words = regex.compile(r"\p{L}+").findall


class Model(NamedTuple):
    domains: list[str]
    vocabulary: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray   # (1 + shape + words) x domains


def shape(text: str) -> list[float]:
    """Figures of a whole text that do not depend on its words."""
    n = max(1, len(text))
    tokens = text.split()
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    signs = sum(map(text.count, "#$%&*|!<>{}[]=+@~^_/\\"))
    t = max(1, len(tokens))
    return [math.log(n), upper / n, digits / n, signs / n, len(text) / t, len(set(tokens)) / t, len(set(lines)) / max(1, len(lines)),
            text.count("!") / t, text.count(".") / t, text.count(",") / t, text.count("\n") / t, float(t < 20)]


def words_of(text: str) -> set[str]:
    """The different words of a whole text and their stems of STEM letters, which stand for inflected forms."""
    words = set(_words(text.lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


def tokens_of(text: str) -> int:
    return len(text.split())


def fit(labels: list[str], places: list[list[int]], names: list[str], shapes: np.ndarray) -> Model | None:
    """Softmax regression by accelerated gradient on a bounded sample; ``places`` are those of its words in ``names``."""
    domains = [d for d in DOMAINS if d in set(labels)]
    if len(domains) < 2:
        return None
    y = np.array([domains.index(x) for x in labels])
    onehot = np.eye(len(domains))[y]
    n = len(y)
    vocabulary = {w: i for i, w in enumerate(names)}
    mean, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
    x = np.zeros((n, 1 + shapes.shape[1] + len(names)), np.float32)
    onehot = onehot.astype(np.float32)
    x[:, 0] = 1
    x[:, 1:1 + shapes.shape[1]] = np.clip((shapes - mean) / scale, -5, 5)
    for i, at in enumerate(places):
        x[i, [1 + shapes.shape[1] + k for k in at]] = 1
    w = z = np.zeros((x.shape[1], len(domains)), np.float32)
    ridge = np.full((x.shape[1], 1), RIDGE / n, np.float32)
    ridge[0] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = np.float32(1 / (0.5 * np.linalg.norm(x @ v) ** 2 / n + ridge.max()))
    for t in range(STEPS):
        s = x @ z
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = z - step * (x.T @ (p - onehot) / n + ridge * z)
        w, z = new, new + np.float32(t / (t + 3)) * (new - w)
    return Model(domains, vocabulary, mean, scale, w.astype(np.float64))


def posterior(model: Model, text: str) -> np.ndarray:
    """Posterior of each domain in steps of 1 / GRID, summing to one."""
    k = len(model.mean)
    s = model.weights[0] + np.clip((np.array(shape(text)) - model.mean) / model.scale, -5, 5) @ model.weights[1:1 + k]
    at = [model.vocabulary[w] for w in model.vocabulary.keys() & words_of(text)]
    if at:
        s = s + model.weights[1 + k + np.sort(np.array(at))].sum(axis=0)
    p = np.exp(s - s.max())
    units = np.round(p / p.sum() * GRID)
    units[np.argmax(units)] += GRID - units.sum()
    return units / GRID


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    known = (labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
             .agg(F.when(F.max("toxic") > 0, "toxic").when(F.min("quality") > 0, "good").otherwise("poor").alias("domain")))
    n = known.count()
    if not n:
        return None
    picked = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
    # broadcast: ids of the sample, whose size is the documented bound; one text an id, however often it comes
    texts = rows.join(F.broadcast(picked), "label_id").groupBy("label_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [v or "" for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sorted(words_of(t)) for t in said], pa.list_(pa.string())),
                 pa.array([shape(t) for t in said], pa.list_(pa.float64()))], ["label_id", "domain", "words", "shape"])

    known_texts = settle(texts.mapInArrow(described, "label_id long, domain string, words array<string>, shape array<double>"), "sample")
    sizes = {r["domain"]: r["n"] for r in known_texts.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    of = lambda d: F.count_if(F.col("domain") == d).cast("double").alias(d)
    counts = known_texts.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*(of(d) for d in sorted(sizes)), F.count(F.lit(1)).alias("total")).filter("total >= 3")
    expected = {d: F.col("total") * (n / sum(sizes.values())) for d, n in sizes.items()}
    gain = sum(((F.col(d) - e) * (F.col(d) - e) / e for d, e in sorted(expected.items())), F.lit(0.0))
    names = [r["word"] for r in counts.orderBy(gain.desc(), "word").select("word").limit(WORDS).collect()]
    place = {w: i for i, w in enumerate(names)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(place[w] for w in ws if w in place) for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), batch.column(3)], ["label_id", "domain", "places", "shape"])

    got = known_texts.mapInArrow(placed, "label_id long, domain string, places array<int>, shape array<double>").toArrow().sort_by("label_id").to_pylist()
    return fit([r["domain"] for r in got], [r["places"] for r in got], names, np.array([r["shape"] for r in got]))


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, p array<double>`` of every whole text, settled."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(tokens_of, texts)), pa.int64()),
                 pa.array([posterior(m, t).tolist() for t in texts], pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def steps_of(p: np.ndarray, residuals: list[np.ndarray], pull: float = PULL) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the accelerated projected-gradient steps with these residuals, from rate 1, and where the next looks."""
    r = z = np.ones(len(p))
    for t, e in enumerate(residuals):
        new = np.maximum(0, z - (p @ e + pull * (z - 1)) / (1 + pull))
        r, z = new, new + t / (t + 3) * (new - r)
    return r, z


def rates_of(p: np.ndarray, residuals: list[np.ndarray]) -> np.ndarray:
    return steps_of(p, residuals)[0]


def fit_rates(cells: DataFrame, domains: list[str], targets: dict[str, float], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Residuals (expected less target, relative to the domain's size) of each projected-gradient step.

    ``cells``: ``p array<double>, n_tokens double``, a row for each posterior vector.
    """
    spark, k = cells.sparkSession, len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    residuals: list[np.ndarray] = []

    def totals() -> np.ndarray:
        shipped = spark.sparkContext.broadcast(list(residuals))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = batch.column(0).flatten().to_numpy().reshape(-1, k)
                    sums = (steps_of(p, shipped.value)[1] * batch.column(1).to_numpy()) @ p
                    yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sums)], ["domain", "tokens"])

        got = cells.select("p", "n_tokens").mapInArrow(run, "domain int, tokens double").groupBy("domain").agg(F.sum("tokens").alias("t")).collect()
        out = np.zeros(k)
        for r in got:
            out[r["domain"]] = r["t"]
        return out

    have = totals()
    if want.sum() <= 0 or have.sum() <= 0:
        return residuals
    want = want / want.sum()
    total = max(have[i] / want[i] for i in range(k) if want[i] > 0)
    # errors count relative to a domain's size, so that small domains settle as fast as large ones; the largest curvature is then 1
    share = np.where(have > 0, have / total, 1.0)
    for _ in range(rounds):
        e = np.round((have - total * want) / total / share, 9)
        if residuals and (np.abs(e - residuals[-1]) * share).max() < SETTLED:
            return residuals
        residuals.append(e)
        have = totals()
    raise RuntimeError(f"rates did not settle in {rounds} steps; last residuals {residuals[-1].tolist()}")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least_one: bool = True) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, p_toxic, p_good, p_poor, rate, copies``."""
    model = train(docs, labels)
    if model is None:
        model = Model(["good"], {}, np.zeros(12), np.ones(12), np.zeros((13, 1)))
    domains = model.domains
    scored = settle(posteriors(docs, model), "posteriors")
    if len(domains) > 1:
        cells = settle(scored.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n_tokens")), "cells")
        residuals = fit_rates(cells, domains, targets or TARGETS)
    else:
        residuals = []
    shipped, k = docs.sparkSession.sparkContext.broadcast(residuals), len(domains)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(rates_of(p, shipped.value), 6))], ["doc_id", "n_tokens", "p", "rate"])

    u = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col("rate") + u)
    if least_one:
        copies = F.when(F.col("rate") < 0.5, F.lit(0)).otherwise(F.greatest(copies, F.lit(1)))
    return (scored.mapInArrow(rate, "doc_id long, n_tokens long, p array<double>, rate double")
            .select("doc_id", "n_tokens", *[(F.col("p")[domains.index(d)] if d in domains else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS], "rate",
                    copies.cast("long").alias("copies")))


def totals(mixed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``domain, target, fitted, realised``: shares of the domains' expected tokens, as wanted, by the rates, and by the copies."""
    names, weights = [f"p_{d}" for d in DOMAINS], targets or TARGETS
    want = sum(max(0.0, weights.get(d, 0.0)) for d in DOMAINS)
    sums = mixed.agg(*(F.sum(F.col(p) * F.col("n_tokens") * F.col(by)).alias(f"{by}_{p}") for p in names for by in ("rate", "copies")))
    whole = lambda by: sum((F.col(f"{by}_{p}") for p in names), F.lit(0.0))
    each = [F.struct(F.lit(d).alias("domain"), F.lit(max(0.0, weights.get(d, 0.0)) / want if want else 0.0).alias("target"),
                     (F.col(f"rate_{p}") / whole("rate")).alias("fitted"), (F.col(f"copies_{p}") / whole("copies")).alias("realised")) for d, p in zip(DOMAINS, names)]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents, each as often as its copies say, with their own columns."""
    names = [f"`{c}`" for c in docs.columns]
    times = mixed.groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    return (docs.join(times, docs["doc_id"].cast("long").eqNullSafe(times["__id"])).filter("__copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names))
