"""The training-data operators against brute force on small fixtures, and their defined cases."""

import collections
import hashlib
import json
import os
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.llm import ann, bpe, chat, exact_dedup, lang_id, mixing, queries, secrets, simhash, suffix_dedup
from codeweave.llm.common import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The word " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def frame(docs):
    return docs.toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, None), (2, ""), (3, LONG), (4, "Same text"), (4, "Same text"), (None, "Same text"), (None, None), (5, "퟿ \U0001f600 é\n\n"), (6, "same TEXT"), (7, "12 34 !!")]
    extra = "doc_id long, text string, h long, key long, z string, __id long, spans string, pack long, name string, fp long, kept boolean, lang string"
    return spark.createDataFrame([(i, t, 1, 1, "z", 1, "s", 1, "n", 1, True, "en" if i and i % 2 else None) for i, t in rows], extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1 BPE ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    return bpe.codec(queries.vocabulary()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(codec, text):
    b = b"".join(codec.encode(text))
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def same(both, text):
    ids = both[1].encode(text, add_special_tokens=False).ids
    assert ids_of(both[0], text) == ids
    assert "".join(both[0].decode(both[0].encode(text), 7)) == both[1].decode(ids, skip_special_tokens=False)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_any_text(both, text):
    same(both, text)


@given(st.lists(st.sampled_from(["ab", "the", " in", "<|endoftext|>", "  ", "\n", "'s", "1234", "ſ", "ʼn", "漢字", " ", "\x1c", "🤖", "a" * 300]), max_size=30).map("".join))
@settings(max_examples=200, deadline=None)
def test_bpe_pieces(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["a" * 40_000, " Leica" * 5000, "icaLe" * 5000, "=-" * 9000, "x" * 6801, "\n" * 20_000, "".join(random.Random(5).choices("abcdefghij", k=50_000)), "Some words é " * 90_000])
def test_bpe_stream_of_long_pieces(both, text):
    same(both, text)


def test_bpe_lookahead_by_hand():
    # ``ab`` can be prevented by ``bc`` (one byte past its end), and that by ``cd``, where that comes first
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 0
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 1
    assert bpe.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 2
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"b", b"c")]) == 0


PIECES = ["ab", "the", " in", "<|endoftext|>", "<|endof", "  ", "\n", " \n \t", "'s", "'r", "'", "'re", "1234", "ſ", "ʼn", "漢字", " ", "\x1c", "🤖", "\ua7cb", "\U00010d4a", "a" * 300, "=" * 9000, " " * 9000, "é" * 8000, "7" * 7000, "\n" * 7000]


@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), st.sampled_from([1, 2, 3, 7, 64, 5000]))
@settings(max_examples=120, deadline=None)
def test_bpe_blocks_of_any_size(both, text, step):
    text = text if step >= 64 else text[-400:]
    ids = both[1].encode(text, add_special_tokens=False).ids
    assert b"".join(both[0].encode(text, step)) == struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_every_byte_goes_through_the_transducer(both, frame):
    """At all times: bytes told + bytes held = bytes fed, on ordinary documents and on one pre-token of 3 MB; what is held is bounded."""
    c = both[0]
    for text in [*frame.text.head(60), "".join(random.Random(1).choices("eainst", k=3_000_000))]:
        machine, fed, told, early, step = bpe.Transducer(c), 0, 0, 0, 256 if len(text) < 10**6 else 1 << 16
        for i in range(0, len(text), step):
            block = text[i:i + step]
            fed += len(block.encode())
            for part in machine.feed(block, i + step >= len(text)):
                told += sum(c.length[x] for x in struct.unpack(f"<{len(part) // 4}I", part))
            waits = len(machine.held) + len(machine.buffer.encode())
            assert told + waits == fed and waits <= 2 * c.block
            early += told > 0 and i + step < len(text)
        assert told == fed and (early > 0 or len(text) <= 2 * step)


def test_bpe_memory_is_flat(both):
    import tracemalloc

    most = []
    for n in (1 << 18, 1 << 20):
        for text in (" some words and" * (n // 15), "ab" * (n // 2)):
            tracemalloc.start()
            count = sum(len(p) for p in both[0].encode(text))
            most.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert count > 0
    assert max(most[2:]) < 1.5 * max(most[:2])


def test_bpe_stream_equals_whole(both):
    c = both[0]
    text = "".join(random.Random(1).choices("eainst", k=30_000))
    whole = c.merge(text.encode())
    assert b"".join(c.encode(text, 500)) == struct.pack(f"<{len(whole)}I", *whole)
    assert list(c.decode([struct.pack("<2I", *(c.single[b] for b in b"\xc3\xa9"))], 1)) == ["", "é", ""]


def test_bpe_refuses_what_it_does_not_know():
    spec = json.loads(queries.vocabulary())
    for change in ({"model": spec["model"] | {"dropout": 0.1}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(spec | change))


def test_bpe_query(spark, docs, frame, both, odd, none):
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, queries.vocabulary(), with_output=True).collect()}
    for i, t in zip(frame.doc_id, frame.text):
        ids = both[1].encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i]["decoded_sha256"] == sha(t) and got[i]["decoded"] == t
    rows = bpe.encode_decode(odd, queries.vocabulary()).collect()
    assert len(rows) == 10 and all(r["decoded_sha256"] == sha("") for r in rows if r["doc_id"] in (1, 2))
    assert bpe.encode_decode(none, queries.vocabulary()).count() == 0


# 2 neighbours --------------------------------------------------------------------------------------------------------

def brute_nearest(ids, x, is_query, k=5):
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        s = (x * x[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
        out[ids[q]] = sorted((-round(v, 12), i) for v, i in zip(s, ids) if i != ids[q])[:k]
    return out


def test_ann_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = t.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    want = brute_nearest(ids, x, lambda i: i % 50 == 0)
    got = ann.nearest(t, lambda c: c % 50 == 0).toPandas()
    hits = sum(len({i for _, i in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 5 * len(want) and set(got.query_id) == set(want)
    exact = {(q, i): -s for q, w in want.items() for s, i in w}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9 for r in got.itertuples() if (r.query_id, r.vec_id) in exact)
    assert all(list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and list(g.sort_values("rank").score) == sorted(g.score, reverse=True) for _, g in got.groupby("query_id"))


def test_ann_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(20)] + [(100, [0.0, 1.0, 0.0, 0.0]), (101, None), (102, [0.0] * 4), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf")] + [1.0] * 3),
                                                             (105, [None, 1.0, 1.0, 1.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 0.0, 0.0, 0.0])]
    t = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int, entry long")
    got = ann.nearest(t, lambda c: c.isin(0, 3, 100, 102)).toPandas()
    assert list(got[got.query_id == 3].sort_values("rank").vec_id) == [0, 1, 2, 4, 5] and list(got[got.query_id == 0].sort_values("rank").vec_id) == [1, 2, 3, 4, 5]
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == [0, 1, 2, 3, 4] and set(got.query_id) == {0, 3, 100}
    assert ann.nearest(t.limit(0), lambda c: c >= 0).count() == 0
    assert ann.nearest(t.filter("vec_id = 100"), lambda c: c >= 0).count() == 0
    far = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(1, 40)] + [(50, [-1.0, 0.0]), (100, [0.0, -1.0])], "vec_id long, embedding array<float>")
    lone = ann.nearest(far, lambda c: c % 50 == 0).toPandas()
    assert list(lone[lone.query_id == 50].sort_values("rank").vec_id) == [100, 39, 38, 37, 36] and len(lone) == 10
    two = ann.nearest(t.filter("vec_id in (100, 1)"), lambda c: c >= 0).toPandas()
    assert sorted(zip(two.query_id, two.vec_id)) == [(1, 100), (100, 1)]


def test_ann_codes_decide_and_lose_nothing():
    """Codes discard most of a cell of clustered vectors, and what is left holds the true best, whatever the mark."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 32)), 100, axis=0) + 0.3 * rng.normal(size=(4000, 32))
    ix = ann.fit(x, 4)
    u = ann.unit(x)
    cell, codes = ann.encode(ix, u)
    slack = ann.left_out(ix, u, cell, codes)
    said = ix.coarse[cell] + np.concatenate([w[codes[:, p]] for p, w in enumerate(ix.words)], axis=1)
    scored = 0
    for q in u[::400]:
        def exact(at):
            nonlocal scored
            scored += len(at)
            return u[at] @ q
        want = np.sort(u @ q)[-6:]
        for mark in (-np.inf, want[0], want[3]):
            got = np.sort(ann.best_of(said @ q, slack, exact, 6, mark)[1])
            assert np.allclose(got[-min(6, len(got)):], want[-min(6, len(got)):]) and len(got) >= (3 if mark == want[3] else 6)
    assert scored < 0.35 * 30 * len(x)
    # all queries together find the same, and nothing that does not reach a mark
    asked, n = u[::400], 600
    for marks in (np.full(len(asked), -np.inf), np.sort(asked @ u[:n].T, axis=1)[:, -4]):
        exact = lambda i, at: (u[at] * asked[i]).sum(axis=1)
        i, at, score = ann.best_of_all(asked @ said[:n].T, slack[:n], lambda m, at: u[at] @ asked[m], exact, 6, marks)
        for m, q in enumerate(asked):
            want = sorted(((u[:n] * q).sum(axis=1)), reverse=True)[:6]
            assert sorted(score[i == m], reverse=True) == [s for s in want if s >= marks[m]] and np.array_equal(score[i == m], exact(i[i == m], at[i == m]))


def test_ann_any_finite_size(spark):
    """Components whose squares overflow or vanish; rows that repeat an id."""
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [-3e-308, 1e-308]), (3, [2.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c == 0).toPandas().sort_values("rank")
    assert list(got.vec_id) == [1, 3, 4, 4, 2] and np.allclose(got.score, [1, 3 / 10 ** 0.5, 0.5 ** 0.5, 0.5 ** 0.5, -2 / 20 ** 0.5])


def test_ann_centroids_in_two_levels(monkeypatch):
    """As many centroids as asked for, about as near to the vectors as those of one level."""
    rng = np.random.default_rng(3)
    x = ann.unit(np.repeat(rng.normal(size=(60, 8)), 30, axis=0) + 0.05 * rng.normal(size=(1800, 8)))
    near = lambda c: np.mean((x @ c.T).max(axis=1))
    flat = ann.centroids(x, 60, np.random.default_rng(1))
    monkeypatch.setattr(ann, "FLAT", 16)
    two = ann.centroids(x, 60, np.random.default_rng(1))
    assert len(flat) == 60 and 50 <= len(two) <= 70 and near(two) > near(flat) - 0.03


def test_ann_hot_cell(spark, monkeypatch):
    """Many near-equal vectors in one cell: codewords cannot tell them apart, the exact rerank must."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 16))
    x[:2000] = x[0] + 0.001 * rng.normal(size=(2000, 16))
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda sample, cells: fit(sample, 1))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(t, lambda c: c % 100 == 0).toPandas()
    want = brute_nearest(np.arange(len(x)), x, lambda i: i % 100 == 0)
    assert {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")} == {q: [i for _, i in w] for q, w in want.items()}


# 3 mixing ------------------------------------------------------------------------------------------------------------

def test_mixing_rates_match_targets(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.dirichlet([1, 2, 1], 60) * 200) / 200
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    n = rng.integers(50, 500, 60).astype(float)
    cells = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(p, n)], "p array<double>, n_tokens double").repartition(3)
    target = {"toxic": 0.1, "good": 0.6, "poor": 0.3}
    res = mixing.fit_rates(cells, mixing.DOMAINS, target)
    r = mixing.rates_of(p, res)
    assert (r >= 0).all()
    got = (r * n) @ p
    assert np.abs(got / got.sum() - [0.1, 0.6, 0.3]).max() < 0.01
    # plain projected gradient in one process, many steps, ends at the same rates
    want = np.array([0.1, 0.6, 0.3])
    have = n @ p
    total = max(have / want)
    x = np.ones(60)
    for _ in range(20_000):
        x = np.maximum(0, x - (p @ (((x * n) @ p - total * want) / have) + mixing.PULL * (x - 1)) / (1 + mixing.PULL))
    cost = lambda r: (((r * n) @ p - total * want) ** 2 / have).sum() / total / 2 + mixing.PULL * (n * (r - 1) ** 2).sum() / total / 2
    assert cost(r) <= cost(x) + 1e-5


def test_mixing_query(spark, docs, frame, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mix(docs, labels).toPandas()
    assert sorted(got.doc_id) == sorted(frame.doc_id)
    assert np.allclose(got.p_toxic + got.p_good + got.p_poor, 1) and (got.rate >= 0).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    assert (m[m.toxic == 0].copies >= 1).all() and (m[m.toxic == 1].copies == 0).mean() > 0.9
    out = mixing.apply_mix(docs, mixing.mix(docs, labels))
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    # totals: by the rates close to the targets, by the copies not far from them; unbiased copies realise the rates
    for least_one, near in ((True, 0.06), (False, 0.06)):
        mixed = mixing.mix(docs, labels, least_one=least_one)
        for r in mixing.totals(mixed).collect():
            assert abs(r["fitted"] - r["target"]) < 0.02 and abs(r["realised"] - r["target"]) < near, r
    few = spark.createDataFrame([(1, 1, 0), (3, 0, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert set(mixing.mix(odd, few).toPandas().rate) == {1.0} and mixing.mix(odd, few.limit(0)).count() == 10
    two = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(odd, two).count() == 10 and mixing.mix(none, labels).count() == 0


def test_mixing_sample_is_bounded(spark, docs):
    """Many rows under one labelled id are one document of the sample; a fit that does not settle is an error."""
    many = docs.unionByName(spark.createDataFrame([(1, f"text {i} " * 30, "en", "s", 9) for i in range(3000)], DOCS))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = mixing.train(docs.filter("doc_id <> 1"), labels), mixing.train(many.filter("doc_id <> 1 or text like 'text%'"), labels)
    assert len(b.vocabulary) <= mixing.WORDS and a.domains == b.domains
    cells = spark.createDataFrame([([0.5, 0.3, 0.2], 10.0), ([0.1, 0.1, 0.8], 5.0)], "p array<double>, n_tokens double")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(cells, mixing.DOMAINS, {"good": 1.0}, rounds=2)


# 4 suffix dedup ------------------------------------------------------------------------------------------------------

def brute_repeats(texts):
    seen = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeats(df, **how):
    return collections.Counter(tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 6, 1])
def test_suffix_dedup_query(docs, frame, large):
    some = frame.head(120)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs.filter(docs.doc_id.isin(some.doc_id.tolist())), large=large).collect()}
    assert [got[i] for i in some.doc_id] == brute_repeats([t.encode() for t in some.text])


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 4, 1])
@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_mutated_copies(spark, seed, large):
    rng = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdefghijklmnop é"
    base = ["".join(rng.choices(alphabet, k=rng.choice([190, 200, 201, 450, 900]))) for _ in range(4)] + ["xy" * 300, "z" * 260]
    texts = []
    for _ in range(25):
        t = list("".join(rng.choice(base)[rng.randrange(30):] for _ in range(rng.randrange(1, 3))))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("QRS")
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert repeats(df, large=large) == collections.Counter(brute_repeats([t.encode() for t in texts]))


def test_suffix_dedup_odd(odd, none):
    rows = [r.asDict() for r in suffix_dedup.remove_repeats(odd, with_text=True).collect()]
    assert len(rows) == 10 and next(r for r in rows if r["doc_id"] == 3)["kept"] == "" and sum(r["n_removed"] for r in rows if r["doc_id"] != 3) == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_ids_are_no_keys(spark):
    """Texts of one id, or of none, with one 32-bit hash: each keeps its own result."""
    from pyspark.sql import functions as F

    made = spark.range(300_000).select(F.expr("repeat(concat(hex(id * 2654435761), ' '), 30)").alias("t"))
    pair = made.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).filter(F.size("ts") > 1).first()["ts"][:2]
    texts = [*pair, pair[0][:250] + "".join(map(chr, range(300, 400)))]
    for ids in ([None, None, 9], [4, 4, 4]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        assert repeats(df) == collections.Counter(brute_repeats([t.encode() for t in texts]))


def test_suffix_dedup_runs(spark):
    """A megabyte of one byte, alone and inside a text: few anchors, and covered whole."""
    data = b"some words " * 3 + b" " * (1 << 20) + bytes(random.Random(8).choices(b"abcdefgh", k=900)) + b"-" * 300
    found, spans = suffix_dedup.text_anchors(data)
    assert len(found) < 1000 and sum(b - a for a, b in spans) >= 1 << 20
    texts = ["x" * 3000, "xy" * 900, "q" * 200, "q" * 201, "a" + " " * 2000 + "b", " " * 199]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert repeats(df) == collections.Counter(brute_repeats([t.encode() for t in texts]))
    big = spark.createDataFrame([(1, data.decode()), (2, "z" * 150)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(big).collect()}
    assert rows[1]["n_spans"] == 2 and (1 << 20) + 300 <= rows[1]["n_removed"] <= (1 << 20) + 301 and rows[2]["n_removed"] == 0


def test_suffix_dedup_many_classes(spark):
    """One passage of 230 bytes in 5,000 different surroundings, and a shorter one that no string of 200 bytes covers."""
    rng = random.Random(9)
    long, short = ("".join(rng.choices("abcdefghij ", k=n)) for n in (230, 190))
    noise = lambda: "".join(rng.choices("klmnopqrst", k=rng.randrange(60, 90)))
    texts = [noise() + (long if i % 3 else short) + noise() for i in range(5000)]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert repeats(df) == collections.Counter(brute_repeats([t.encode() for t in texts]))


@given(st.lists(st.binary(max_size=150).map(lambda b: bytes(x % 3 for x in b)), max_size=25))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_order(strings):
    assert [strings[i] for i in suffix_dedup.deep_shallow(strings, 0, 16)] == sorted(strings)


# 5 chat --------------------------------------------------------------------------------------------------------------

def chat_by_hand(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for _, _, r, x in ts)), len(loss), sha(loss))
    return out


def test_chat_query(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.QUERIES["op5_chat"](spark, SF).collect()}
    assert got == chat_by_hand([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()] + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])


@pytest.mark.parametrize("budget", [40, 200, 1024])
def test_chat_windows(spark, budget):
    rng = random.Random(budget)
    rows = [(c, k, "system" if k == 0 and c % 2 else rng.choice(["user", "assistant", "a]b|c", None]), rng.choice([None, "", "\\l<[|]\\e", "</s><s>[user|n]", "word " * rng.randrange(60), "é漢😀" * 9]))
            for c in range(12) for k in range(rng.randrange(1, 40))] + [(3, None, "user", "first"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 0, "assistant", "x")]
    t = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, window int, head string")
    shown = chat.windows(t, budget)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(shown).collect()}
    assert got == chat_by_hand(rows)
    check_windows(shown, budget, chat.HISTORY_TURNS)


def check_windows(shown, budget, history, tokens=lambda piece: -(-len(piece) // 4)):
    """Every window: the system turn, then the longest run of earlier turns that fits, then its own turns; over the budget only where one turn is."""
    by_conv = collections.defaultdict(list)
    for r in shown.collect():
        pieces = [x + "</s>" for x in r["formatted"].split("</s>")[:-1]]
        by_conv[r["conv_id"]].append((r["window"], [(*re.match(r"<s>\[(.*?)\|([nhs])\]", x).groups(), x) for x in pieces]))
    for windows in by_conv.values():
        before, system = [], None
        for _, parts in sorted(windows):
            kinds = "".join(k for _, k, _ in parts)
            assert re.fullmatch("s?h{0,%d}n+" % history, kinds)
            plain = lambda x: x.replace("|h]", "|n]").replace("|s]", "|n]")
            own = [(r, plain(x)) for r, k, x in parts if k == "n"]
            said = [plain(x) for _, k, x in parts if k == "h"]
            assert (kinds[0] == "s") == (system is not None) and (system is None or plain(parts[0][2]) == system)
            earlier = [x for x in before if x is not system]
            assert said == (earlier[-len(said):] if said else [])
            here = next((x for r, x in own if r == "system"), None) if system is None else None
            spent = sum(tokens(x) for _, _, x in parts)
            if spent > budget:
                assert len(own) - (here is not None) <= 1 and not said
            later = [x for x in own if x[1] is not here]
            longer = before[-len(said) - 1:][:1] if before[-1:] != [system] else []
            if len(said) < min(history, len(earlier)) and later and longer and longer[0] is not system:
                reserved = tokens(system or "") if system else 0
                assert reserved + sum(tokens(x) for x in [*said, longer[0], *(x for _, x in own if x is not here)]) > budget or here
            system = system or here
            before += [x for _, x in own]


def test_chat_long_system_turn_and_given_tokens(spark):
    """A system turn longer than the budget is in every window; so is one that comes late, from there on; token counts may be given."""
    rows = [(1, 0, "system", "rule " * 2000)] + [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 30)]
    rows += [(2, 0, "user", "early " * 300), (2, 1, "system", "late"), *((2, k, "assistant", "word " * 150) for k in range(2, 12))]
    t = spark.createDataFrame([(*r, 7 if r[1] else None) for r in rows], "conv_id long, turn long, role string, text string, n long")
    shown = chat.windows(t, 1024)
    check_windows(shown, 1024, chat.HISTORY_TURNS)
    first = [r["formatted"] for r in shown.filter("conv_id = 1").collect()]
    assert len(first) == 30 and all("rule rule" in x for x in first)
    given = chat.windows(t, 40, n_tokens="n")
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(given).collect()} == {1: 30, 2: 12}
    assert all(x["formatted"].count("</s>") <= 6 for x in given.collect())
    for budget in (0, 1, 3):
        assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.windows(t, budget)).collect()} == {1: 30, 2: 12}


def test_chat_empty(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(t)).count() == 0 and chat.read_back(chat.windows(chat.probe_conversation(t))).count() == 1


# 6 SimHash -----------------------------------------------------------------------------------------------------------

def simhash_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x.encode(), seed=42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def groups_by_hand(ids, linked):
    top = {i: i for i in ids}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, docs, frame, odd, none):
    fp = {i: simhash_by_hand(t) for i, t in zip(frame.doc_id, frame.text)}
    comp = groups_by_hand(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (None, zero, 1)} <= got and {c for i, _, c in got if i in (4, 6)} == {4}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("large", [simhash.LARGE, 4])
def test_simhash_links_are_complete(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(12)} | {0, 1, 3, 7, 15, (1 << 64) - 1})
    fps = [f & (1 << 64) - 1 for f in fps]
    arr = np.array(fps, np.uint64)
    table = simhash._distances(arr, simhash.pivots())
    edges = []
    for k, keys in enumerate(simhash.bucket_keys(arr)):
        free = ((1 << 64) - 1) & ~simhash.fixed_bits(k)
        edges += [(int(x), int(y)) for a, b in simhash.links(keys, arr, table, 2, free) for x, y in zip(a, b)]
    want = groups_by_hand(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    e = set(edges)
    assert all((a ^ b).bit_count() <= 64 for a, b in e) and groups_by_hand(fps, lambda a, b: (a, b) in e or (b, a) in e) == want


def test_similar_groups(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, want = [], []
    for g in range(12):
        base = [word() for _ in range(rng.choice([120, 400]))]
        for c in range(rng.choice([1, 2, 90 if g == 0 else 3])):
            w = base[:]
            for _ in range(c and len(w) // 100):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            want.append(g)
    far = texts[0].split()
    texts.append(" ".join(x if i % 12 else word() for i, x in enumerate(far)))  # similarity near 0.4
    want.append(99)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert [want.index(g) for g in want] == [got[i] for i in range(len(texts))]
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted({want.index(g) for g in want})


def test_similar_groups_on_both_sides_of_the_threshold(spark):
    """Pairs of 5 to 450 shingles at 0.8 are all linked, pairs just below are not."""
    texts, pairs = [], []
    for g in range(150):
        n = [5, 9, 45, 450][g % 4]
        inside = g % 2 == 0 or g % 3 == 0
        share = -(-4 * n // 5) if inside else -(-4 * n // 5) - 1  # of n shingles, the other text is a prefix of these
        w = [f"w{g}x{i}" for i in range(n + 4)]
        pairs.append((len(texts), inside))
        texts += [" ".join(w), " ".join(w[:share + 4])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert [(i, got[i + 1] == i) for i, _ in pairs] == pairs


@pytest.mark.parametrize("members", [simhash.MEMBERS, 40])
def test_similar_pairs_are_found_at_the_threshold(spark, monkeypatch, members):
    """Pairs at similarities from 0.8 on by scattered changes of single words; a crowd of near copies, a third of all rows, is one group."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng, texts, pairs = random.Random(21), [], []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    sets = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    while len(pairs) < 600:
        w = [word() for _ in range(rng.choice([60, 150, 400]))]
        v = w[:]
        for _ in range(max(1, round(len(w) * rng.uniform(0.012, 0.026)))):
            v[rng.randrange(len(v))] = word()
        x, y = sets(w), sets(v)
        j = len(x & y) / len(x | y)
        if 0.72 <= j <= 0.9:
            pairs.append((len(texts), j >= 0.8))
            texts += [" ".join(w), " ".join(v)]
    base = [word() for _ in range(300)]
    crowd = len(texts)
    for i in range(600):
        w = base[:]
        w[rng.randrange(300)] = word()
        texts.append(" ".join(w))
    # copies that are further from each other than from the text they come from: groups by brute force
    loose = len(texts)
    for i in range(150):
        w = base[:]
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(300)] = "n" + word()
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert [(i, got[i + 1] == i) for i, _ in pairs] == pairs
    assert {got[i] for i in range(crowd, loose)} == {crowd}
    own = {i: sets(texts[i].split()) for i in range(crowd, len(texts))}
    linked = lambda a, b: len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])
    assert {i: got[i] for i in own} == groups_by_hand(own, lambda a, b: b >= loose and linked(a, b) or b < loose)


def test_links_do_not_depend_on_the_order_of_arrival(spark):
    """Tasks that run again get their rows in another order; after the sort of a bucket the links are the same rows."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(b % 3, b ^ sum(1 << rng.randrange(60) for _ in range(rng.randrange(3)))) for b in base for _ in range(9)]
    table = spark.createDataFrame(sorted(set(rows)), "key long, fp long").mapInArrow(lambda it: it, "key long, fp long")
    far = table.selectExpr("fp", "key as least").mapInArrow(simhash._tables, "fp long, least long, far binary").selectExpr("least as key", "fp", "far")
    told = set()
    for seed in range(3):
        met = far.orderBy(F.xxhash64("fp", F.lit(seed))).repartition("key").sortWithinPartitions("key", "fp")
        told.add(tuple(sorted((r["a"], r["b"]) for r in met.mapInArrow(lambda it: simhash._by_key(it, "key", simhash._links), "a long, b long").collect())))
    assert len(told) == 1 and len(told.pop()) > 20


@pytest.mark.parametrize("kinds", [[100], [15, 100]])
def test_leaders_lose_no_pair(kinds):
    """Crowds: every pair within the allowed bits is joined through leaders, across two rounds of them, small sets among them."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (6, simhash.WIDE_WORDS), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 400)].copy()
    for i in range(400):
        for _ in range(rng.integers(0, 40)):
            fps[i, rng.integers(0, simhash.WIDE_WORDS)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    import pyarrow as pa

    refs = simhash.pivots(simhash.WIDE_PIVOTS * simhash.WIDE_WORDS).reshape(simhash.WIDE_PIVOTS, simhash.WIDE_WORDS)
    far = [simhash._differing(refs, f).astype(np.uint8).tobytes() for f in fps]
    t = pa.table({"key": np.zeros(400, np.int64), "node": np.arange(400), "fp": [f.tobytes() for f in fps], "far": far, "n": (n := rng.choice(kinds, 400))})
    edges = set()
    thin = pa.concat_tables([pa.Table.from_batches(simhash._thin(iter(t.slice(i, 100).to_batches()))) for i in range(0, 400, 100)])
    edges |= {(a, b) for a, b in zip(thin["node"].to_pylist(), thin["leader"].to_pylist()) if b is not None}
    left = thin.filter(pa.compute.is_null(thin["leader"])).drop_columns("leader")
    for batch in simhash._loose(0.8)(left):
        edges |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    got = groups_by_hand(range(400), lambda a, b: (a, b) in edges or (b, a) in edges)
    close = [(i, j) for i in range(400) for j in range(i) if int(simhash._differing(fps[i], fps[j])) <= simhash.farthest(0.8) + (simhash.SMALL_SPREAD if min(n[i], n[j]) <= simhash.SMALL else 0)]
    assert len(close) > 1000 and all(got[i] == got[j] for i, j in close) and left.num_rows < 400


def test_keep_one_keeps_one_row(spark):
    """Repeated winners, null ids, and one id with several texts."""
    words = " ".join(f"v{i}" for i in range(60))
    rows = [(9, "same"), (9, "same"), (4, "same"), (None, "no id"), (None, "no id"), (7, words), (7, words + " more"), (7, words), (8, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    exact = sorted(map(tuple, exact_dedup.keep_one(df).collect()), key=key)
    assert exact == sorted([(9, "same"), (None, "no id"), (7, words), (7, words + " more"), (8, "other")], key=key)
    near = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert len(near) == 4 and [i for i, _ in near].count(7) == 1 and (4, "same") in near and (None, "no id") in near


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (5, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    e = set(edges)
    want = groups_by_hand(sorted({x for p in edges for x in p}), lambda a, b: (a, b) in e or (b, a) in e)
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 exact dedup -------------------------------------------------------------------------------------------------------

def dedup_by_hand(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    g = collections.defaultdict(list)
    for i, t in rows:
        g[low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in g.items()}
    return collections.Counter((i, keep[low(t)], len(g[low(t)]), i == keep[low(t)], sha(low(t))) for i, t in rows)


@pytest.mark.parametrize("name", [exact_dedup.name_of, lambda c: bytes([sum(c) % 5])])
def test_exact_dedup(spark, frame, odd, none, name):
    """The second naming collides all the time; the result must not change."""
    rows = list(zip(frame.doc_id.tolist(), frame.text)) + [(5000, frame.text[0].upper()), (5001, LONG + "a"), (5002, LONG + "b"), (5003, "x" + LONG), (5004, LONG + "A"), (5005, "É"), (5006, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collections.Counter(map(tuple, exact_dedup.exact_duplicates(df, name).select(*cols).collect())) == dedup_by_hand(rows)
    o = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert collections.Counter(map(tuple, exact_dedup.exact_duplicates(odd, name).select(*cols).collect())) == dedup_by_hand(o)
    assert exact_dedup.exact_duplicates(none, name).count() == 0


def test_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(300_000))
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MOST and min(map(len, parts[:-1])) >= exact_dedup.LEAST
    moved = exact_dedup.chunks(b"some words before" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert exact_dedup.chunks(b"") == [] and b"".join(exact_dedup.chunks(b"a" * 200_000)) == b"a" * 200_000


def test_exact_keep_one(odd, docs, frame):
    out = exact_dedup.keep_one(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3, 5, 6, 7]
    assert exact_dedup.keep_one(docs).count() == frame.text.str.lower().nunique()


# 9 secrets -----------------------------------------------------------------------------------------------------------

PLAIN = [re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile("gh[pousr]_([A-Za-z0-9]+)"), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")]


def secrets_by_hand(t):
    long_enough = [lambda m: len(m[1]) >= 8, lambda m: len(m[0]) >= 16, lambda m: len(m[0]) >= 32, lambda m: len(m[1]) >= 36, lambda m: True]
    return sorted((m.start(), k, m.end()) for k, r in enumerate(PLAIN) for m in r.finditer(t) if long_enough[k](m))


@given(st.lists(st.sampled_from(["token", "secret", "password", "passwd", "API_KEY", "apikey", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "é", "\n", "-----BEGIN ", "RSA ", "PRIVATE KEY-----",
                                 "ghp_", "A1b2C3d4E5f6" * 3, "K", "AAKIA", "ſecret"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_secrets_any(text):
    assert secrets.scanner().scan(text) == secrets_by_hand(text)


def test_secrets_query(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    frame = docs.toPandas()
    kinds = ["assign", "access", "hex", "github", "pem"]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    assert sum(len(r["spans"]) > 0 for r in got.values()) > 0
    for i, t in zip(frame.doc_id, frame.text):
        found = secrets_by_hand(t)
        said = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
        assert got[i]["spans"] == ",".join(said) and got[i]["base_sha256"] == sha(",".join(x for x, f in zip(said, found) if f[1] < 3))
        assert [got[i][f"n_{k}"] for k in kinds[:3]] == [sum(f[1] == k for f in found) for k in range(3)]
    assert secrets.find_secrets(odd).count() == 10 and secrets.find_secrets(none).count() == 0


# 10 language ---------------------------------------------------------------------------------------------------------

def test_lang_query(spark, docs, frame, odd, none):
    got = lang_id.identify(docs).toPandas().merge(frame[["doc_id", "lang"]], on="doc_id")
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    assert lang_id.accepted(docs).columns == docs.columns
    rows = {(r["doc_id"], r["lang_pred"]) for r in lang_id.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (7, "und"), (3, "en")} <= rows
    assert lang_id.identify(none).count() == 0 and lang_id.accepted(none).count() == 0 and {r["lang_pred"] for r in lang_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def model_of(texts):
    grams, counts = [], []
    for ts in texts.values():
        g = collections.Counter()
        for t in ts:
            b = lang_id.PAD + t
            g.update(int.from_bytes(b[i:i + lang_id.ORDER + 1], "big") for i in range(len(b) - lang_id.ORDER))
        grams.append(np.array(sorted(g), np.int64))
        counts.append(np.array([g[k] for k in sorted(g)]))
    return lang_id.Model(list(texts), grams, counts)


def plain_code_length(texts, text):
    """A walk through the context tree of one language, byte by byte: escapes from the longest known context down."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        b = lang_id.PAD + t
        for i in range(lang_id.ORDER, len(b)):
            for k in range(lang_id.ORDER + 1):
                seen[b[i - k:i]][b[i]] += 1
    b, total = lang_id.PAD + text, 0.0
    for i in range(lang_id.ORDER, len(b)):
        for k in range(lang_id.ORDER, -1, -1):
            c = seen.get(b[i - k:i])
            if c and b[i] in c:
                total -= np.log2(c[b[i]] / (c.total() + len(c)))
                break
            if c:
                total -= np.log2(len(c) / (c.total() + len(c)))
        else:
            total += 8
    return total


@pytest.mark.parametrize("group, block", [(8, 1 << 17), (1, 7), (2, 64)])
def test_lang_code_lengths_are_exact(monkeypatch, group, block):
    """Several texts side by side, cut into blocks and groups of languages of any size."""
    monkeypatch.setattr(lang_id, "GROUP", group)
    monkeypatch.setattr(lang_id, "BLOCK", block)
    texts = {"x": [b"abracadabra", b"cab\n"], "y": [b"bananarama"], "z": ["дом да дым".encode(), b"\x00\xff"]}
    tables = lang_id.Tables(model_of(texts))
    asked = [b"banda!", b"a", "дама".encode(), b"\xfe" * 30, b"abracadabra" * 9]
    want = [[plain_code_length(ts, t) for ts in texts.values()] for t in asked]
    assert np.allclose(tables.lengths(asked), want, rtol=1e-5)


@pytest.mark.parametrize("latin", [4, 50])
def test_lang_many_languages_and_scripts(latin):
    """Made-up languages, two for each of four scripts, beside few or many Latin ones: the others do not matter."""
    rng = random.Random(11)
    scripts = {"big": [chr(0x4E00 + i) for i in range(300)], "cyrillic": [chr(0x430 + i) for i in range(32)], "greek": [chr(0x3B1 + i) for i in range(24)], "kana": [chr(0x3041 + i) for i in range(46)]}

    def language(letters, seed):
        r = random.Random(seed)
        words = ["".join(r.choices(letters, k=r.randrange(1, 3) if len(letters) > 100 else r.randrange(2, 6))) for _ in range(150)]
        return lambda n: " ".join(rng.choices(words, k=n))

    made = {f"{k}{i}": language(v, f"{k}{i}") for k, v in scripts.items() for i in range(2)}
    made |= {f"latin{i}": language("abcdefghijklmnopqrstuvwxyz", f"latin{i}") for i in range(latin)}
    tables = lang_id.Tables(model_of({k: [say(60).encode() for _ in range(12)] for k, say in made.items()}))
    names = list(made)
    asked = [(k, say(15).encode()) for k, say in made.items() for _ in range(10)]
    right = [names[i] == k for (k, _), i in zip(asked, tables.lengths([t for _, t in asked]).argmin(axis=1))]
    assert np.mean(right) >= 0.99 and np.mean(right[:80]) >= 0.98


def test_lang_accepted(spark, docs):
    """Rejections take effect, others keep their columns; a null language becomes the prediction."""
    some = docs
    hidden = some.selectExpr("doc_id", "text", "if(doc_id % 9 = 0, null, lang) as lang", "source", "n_chars")
    noise = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 456 !!", "en", "s", 9), (10**6 + 2, "".join(map(chr, range(0x500, 0x900))), None, "s", 9)], DOCS)
    out = {r["doc_id"]: r["lang"] for r in lang_id.accepted(hidden.unionByName(noise)).collect()}
    want = {r["doc_id"]: r["lang"] for r in some.collect()}
    assert set(out) == set(want) and all(out[i] == want[i] for i in want if i % 9) and np.mean([out[i] == want[i] for i in want if i % 9 == 0]) >= 0.9
    one = some.first()["lang"]
    assert {r["lang"] for r in lang_id.accepted(some, languages=[one]).collect()} == {one}


# all -----------------------------------------------------------------------------------------------------------------

def test_secrets_sql_on_generated_texts():
    """The SQL form, of another regex engine, against the automata on texts made of pieces of secrets."""
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    bits = ["password", "PassWd", "\u017fecret", "toKen", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCD1234", "EFGHIJKLMNOP", "0123456789abcdef", "deadbeef" * 4,
            "f", "ghp_", "a1B2" * 9, "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "\n", "\u00e9", "\u65e5\u672c", "\U0001f600", "e\u0301", "+/=.-_", "x", "\t"]
    documents = pd.DataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(4000)], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = dict(con.execute(f"select doc_id, spans from ({queries.ORACLE_SQL['op9_secrets']})").fetchall())
    s = secrets.scanner()
    seen = set()
    for i, text in zip(documents.doc_id, documents.text):
        found = s.scan(text)
        seen |= {k for _, k, _ in found}
        assert ",".join(f"{s.rules[k].kind}:{a}:{b}" for a, k, b in found) == want[i], text
    assert seen == set(range(len(secrets.RULES)))


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name


def test_pipeline_against_plain_stages(spark, frame):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        before, docs = docs, c.settle(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != c.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert kept["language_id"].count() == len(frame)
    texts = frame.assign(low=frame.text.str.lower())
    assert {r["doc_id"] for r in kept["exact_dedup"].select("doc_id").collect()} == set(texts.groupby("low").doc_id.max())
    p = kept["exact_dedup"].toPandas()

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    s = {i: shingles(t) for i, t in zip(p.doc_id, p.text)}
    near = {r["doc_id"] for r in kept["simhash_dedup"].select("doc_id").collect()}
    j = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    assert not [(a, b) for a in near for b in near if a < b and j(a, b) >= 0.8]
    assert all(any(j(a, b) >= 0.8 for b in s if b != a) for a in set(s) - near)
    mixed = kept["mixing"].toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    gone = near - set(mixed.doc_id)
    assert all(labels.get(i, 1) == 1 for i in gone) and len(gone) > 0
    last = kept["bpe"].toPandas()
    assert sorted(last.doc_id) == sorted(mixed.doc_id)
    text = dict(zip(mixed.doc_id, mixed.text))
    assert all(r.decoded_sha256 == sha(text[r.doc_id]) for r in last.itertuples())


def test_json_of_vocabulary_is_not_in_the_repository():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, fs in os.walk(here) if ".git" not in d for f in fs if f.endswith((".tiktoken", ".model")) or f == "byte_bpe_50k.json"]
    assert json.loads(queries.vocabulary())["model"]["type"] == "BPE"
