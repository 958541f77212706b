"""Whitening, hard negatives and packing against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import negatives, packing, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
DATA = "/root/testdata/sf0.001"


def odd_vectors(rng, dims):
    good = rng.normal(0, 0.2, dims).tolist()
    return [(None, None, 1), (9001, None, None), (9002, [*good[:-1], None], 1), (9003, [*good[:-1], float("nan")], 2), (9004, [*good[:-1], float("inf")], 2), (9005, [], 1), (9006, good[:-2], 3), (None, good, 3)]


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x], c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize(("spread", "dims"), [("flat", 24), ("steep", 40), ("thin", 12), ("narrow", 3)])
def test_whitening(spark, spread, dims):
    """Flat spectra need the whole space, steep ones end before; rows of fewer directions have fewer components."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, dims))
    x *= {"flat": 0.1, "narrow": 0.2}.get(spread) or {"steep": 3.0 * 2.0 ** -np.arange(dims), "thin": np.r_[0.3, 0.2, 0.1, np.zeros(dims - 3)]}[spread]
    x = (x @ np.linalg.qr(rng.normal(size=(dims, dims)))[0] if spread == "steep" else x).astype(np.float32)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows + odd_vectors(rng, dims)[:-1], VECTORS).repartition(5)
    got = defaultdict(list)
    for r in whitening.whiten(df, "embedding", ["vec_id"]).orderBy("component").collect():
        got[r.vec_id].append(r)
    deviation, white, explained = plain_whitening(x, 8)
    assert set(got) == set(range(300)) and all(len(v) == white.shape[1] for v in got.values())
    mine = np.array([[r.whitened for r in got[i]] for i in range(300)])
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert [int(got[i][0].deviation) for i in range(300)] == deviation and got[0][0].n == 300
    assert np.allclose([r.explained for r in got[7]], explained, rtol=1e-9) and got[0][0].identity_error < 1e-9


def test_whitening_ends_early_where_residuals_allow(spark):
    """A steep spectrum is found in a basis of fewer directions than dimensions; a flat one takes the whole space."""
    rng = np.random.default_rng(1)
    for scale, whole in ((np.r_[2.0 ** -np.arange(8), np.full(32, 1e-6)], False), (np.full(40, 0.1), True)):
        x = spark.createDataFrame([(v,) for v in np.floor(1e6 * rng.normal(0, 1, (400, 40)) * scale).astype(int).tolist()], "x array<long>")
        model = whitening.fit(x, 8)
        assert (model.directions == 40) is whole and len(model.values) == 8


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(odd_vectors(rng, 5), VECTORS)
    for t in (df.limit(0), df, spark.createDataFrame([(1, [0.5, 1.0], 0)] * 5, VECTORS)):
        assert whitening.whiten(t, "embedding", ["vec_id"]).count() == 0
    twice = spark.createDataFrame([(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (None, [0.25, 3.0], 1)], VECTORS).withColumn("x", F.lit("kept"))
    got = whitening.whiten(twice, "embedding", ["vec_id", "x"]).collect()
    assert sorted((r.vec_id or 0, r.component, r.x) for r in got) == [(0, 1, "kept"), (1, 1, "kept"), (1, 1, "kept")]
    with pytest.raises(ValueError, match="clash"):
        whitening.whiten(df.withColumn("N", F.lit(1)), "embedding", ["N"])
    # deviations that pass a long are exact still
    far = [(i, [float(s) * 3e9]) for i, s in enumerate((1, -1, 2))]
    big = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(far, "vec_id long, v array<double>"), "v", ["vec_id"]).collect()}
    x = [int(np.floor(1024 * v[0])) + 100_000 for _, v in far]
    assert big == {i: (3 * a - sum(x)) ** 2 for i, a in enumerate(x)} and max(big.values()) > 2**63


def plain_negatives(rows, anchor, positives=5, negatives=10):
    """rows: (id, label, vector) in order of ids, nulls last."""
    out = []
    for i, (a, label, x) in enumerate(rows):
        if not anchor(a):
            continue
        scored = sorted(((sum(p * q for p, q in zip(x, y, strict=True)), j) for j, (_, _, y) in enumerate(rows) if j != i), key=lambda s: (-s[0], s[1]))
        for score, p in [s for s in scored if rows[s[1]][1] == label][:positives]:
            hard = [s for s in scored if rows[s[1]][1] != label and 30 * score <= 100 * s[0] <= 90 * score][:negatives]
            out += [(a, rows[p][0], k, rows[j][0], score, s) for k, (s, j) in enumerate(hard, 1)]
    return sorted(out, key=repr)


def mined(df, **options):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 10 == 0, **options).collect()), key=repr)


def test_hard_negatives(spark, monkeypatch):
    """Small blocks, repeated rows and ids, null ids, and scores that tie in hundreds of rows."""
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "ROWS", 32)
    rng = random.Random(3)
    common = [3, 1, 2, 2]
    rows = [(i, rng.randrange(3), common if rng.random() < 0.5 else [rng.randrange(-4, 6) for _ in range(4)]) for i in range(400)]
    rows += rows[100:120] + [(None, rng.randrange(3), [rng.randrange(-4, 6) for _ in range(4)]) for _ in range(5)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    df = spark.createDataFrame(rows + [(7, None, [1, 2, 3, 4]), (8, 1, None), (9, 1, [1, None, 2, 3]), (10, 1, [1, 2])], "id long, label int, x array<long>").withColumn("score", F.lit("x"))
    expected = plain_negatives(rows, lambda a: a is not None and a % 10 == 0)
    assert mined(df.repartition(3)) == expected and len(expected) > 500
    assert mined(df, positives=2, negatives=60) == plain_negatives(rows, lambda a: a is not None and a % 10 == 0, 2, 60)


def test_hard_negatives_of_large_numbers(spark):
    """Scores beyond what doubles hold exactly are right; beyond longs they are refused."""
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.randrange(-(10**8), 10**8) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, x array<long>")
    assert mined(df) == plain_negatives(rows, lambda a: a % 10 == 0)
    assert mined(df.limit(0)) == [] and mined(df.where("id % 10 <> 0")) == [] and mined(df.where("label = 0")) == []
    with pytest.raises(ValueError, match="range of longs"):
        mined(spark.createDataFrame([(0, 1, [2**40]), (1, 1, [1])], "id long, label int, x array<long>"))


def test_hard_negative_query_takes_no_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 6).tolist(), int(rng.integers(10)) if i % 9 else None) for i in range(300)] + odd_vectors(rng, 6)
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op12_hard_negatives(spark, str(tmp_path)).collect()), key=repr)
    known = [(i, (b + 1) % 10 if i is not None and i % 7 == 0 else b, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v, b in rows if b is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    known.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert got == plain_negatives(known, lambda a: a is not None and a % 100 == 0)


def plain_brackets(slot):
    opened, out = [], []
    for i, s in enumerate(slot):
        if s == 0:
            opened.append(i)
        elif opened:
            out.append((opened.pop(), i))
    return sorted(out)


@given(st.lists(st.integers(0, 1), max_size=60), st.integers(1, 6))
def test_brackets_and_meetings(slots, parts):
    """Sweeps of ranges and the meetings of what they leave together are one sweep over all."""
    slot = np.array(slots, int)
    assert sorted(zip(*map(np.ndarray.tolist, packing.bracket(slot)), strict=True)) == plain_brackets(slots)
    found, left, rest = [], [], {}
    for p, at in enumerate(np.array_split(np.arange(len(slot)), parts)):
        a, b = packing.bracket(slot[at])
        found += zip(at[a].tolist(), at[b].tolist(), strict=True)
        free = np.delete(at, np.r_[a, b]).tolist()
        rest[p] = ([i for i in free if slot[i] == 0][::-1], [i for i in free if slot[i] == 1])
        left.append((p, len(rest[p][0]), len(rest[p][1])))
    for p, first, s, start, n in packing.meetings(left):
        found += [(rest[p][0][first + k], rest[s][1][start + k]) for k in range(n)]
    assert sorted(found) == plain_brackets(slots)


def plain_best_fit(sizes, length):
    gaps, opened = [0] * (length + 1), 0
    for s in sorted(sizes, reverse=True):
        g = next((g for g in range(s, length + 1) if gaps[g]), None)
        opened, g = (opened + 1, length) if g is None else (opened, g)
        gaps[g] -= g < length
        gaps[g - s] += g > s
    return opened


@pytest.mark.parametrize("kind", ["wide", "halves", "short", "one length"])
def test_packed_as_few_as_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "RANGE_ROWS", 150)
    rng = np.random.default_rng(8)
    size = {"wide": rng.integers(1, 129, 500), "halves": rng.integers(50, 80, 300), "short": rng.integers(1, 9, 600), "one length": np.full(300, 43)}[kind]
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(size)], "number long, size long")
    got = packing.packed(df, 128).collect()
    full = defaultdict(int)
    for r in got:
        full[r.seq] += r.size
    assert sorted((r.number, r.size) for r in got) == list(enumerate(size.tolist())) and max(full.values()) <= 128
    assert len(full) <= plain_best_fit(size.tolist(), 128) * 1.01 + 1


def test_least_sequences():
    assert packing.least_sequences({}, 10) == 0 and packing.least_sequences({6: 5}, 10) == 5 and packing.least_sequences({5: 4}, 10) == 2
    assert packing.least_sequences({6: 2, 5: 3}, 10) == 4 and packing.least_sequences({1: 11}, 10) == 2


def test_pack(spark):
    rng = random.Random(2)
    texts = ["", None, "a b c", "word " * 3000, "x" * 9000, "<|endoftext|> and more", "  \n\n  é漢🙂", "tie"] + ["".join(rng.choice("abc é\n漢1'") for _ in range(rng.randrange(400))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i != 2 else None, t, i) for i, t in enumerate([*texts, *texts[:9]])], "doc_id long, text string, size int")
    rows = packing.pack(docs, ["doc_id", "size"], 256).collect()
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.size].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate([*texts, *texts[:9]]):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.length == 256 for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine) and mine[0].start == 0
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and sum(s[-1]) <= 256
    assert len(seqs) <= sum(r.length for r in rows) / 256 * 1.05 + 1
    assert packing.pack(docs.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        packing.pack(docs.withColumn("Offset", F.lit(1)), ["Offset"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab' \n\tst漢é1. \x1ć", max_size=120))
def test_ranks_give_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    assert packing.tokenizer(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))(text) == plain.encode(text, add_special_tokens=False).ids


def test_new_queries_run(spark):
    for name in ("op11_embedding_whitening", "op12_hard_negatives", "op13_best_fit_packing"):
        assert queries.QUERIES[name](spark, DATA).count() > 0
