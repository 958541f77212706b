"""Near-dedup, shared passages and components against brute force."""

import random

import numpy as np
import pytest

from palimpsest.llm import neardup, passages
from palimpsest.llm.components import components
from palimpsest.llm.shingles import shingle_hashes, word_hashes

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)}


def group(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(base)
        out.append(" ".join(w))
    return out


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(3, 200))) for _ in range(60)]
    texts += group(rng, words(rng, 150), 130, 7) + group(rng, words(rng, 40), 30, 2) + group(rng, words(rng, 300), 12, 3)
    texts += [texts[0]] * 25 + [texts[0].upper(), texts[0].replace(" ", " \n")] + ["", "  \t", "one two", "ONE  two", "one two three"]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)


def test_blocks_alone_link_a_group(spark):
    rng = random.Random(9)
    base = words(rng, 120)
    texts = sorted(set(group(rng, base, 80, 9)))
    sets = [np.unique(shingle_hashes(word_hashes([t])[0])) for t in texts]
    links = neardup._forest([(bytes([i]), True, s) for i, s in enumerate(sets)], True, 85)
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sets[a[0]], sets[b[0]]
        both = len(np.intersect1d(x, y))
        assert 100 * both >= 85 * (len(x) + len(y) - both)
        top[find(a[0])] = find(b[0])
    expected = brute(list(enumerate(texts)))
    assert len({find(i) for i in range(len(sets))}) == len({c for _, _, c, _ in expected})


def test_near_duplicates_edges(spark):
    text = " ".join(f"x{i}" for i in range(40))
    docs = spark.createDataFrame([(1, None, 5), (2, text, 5), (2, text, 6), (None, text, 7), (9, text + " x", 8)], "doc_id long, text string, kept int")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 36, 2, True), (2, 36, 2, True), (None, 36, 2, False), (9, 37, 2, False)], key=repr)
    assert sorted((r.doc_id, r.kept) for r in neardup.keep_one(docs).collect()) in ([(1, 5), (2, 5)], [(1, 5), (2, 6)])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 200), (5, 5)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(20)]
    top = {x: x for l in links for x in l}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    expected = {(x, find(x)) for l in links if l[0] != l[1] for x in l}
    assert {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == expected


def spans_of(row):
    return {i for s in row.spans for i in range(s.start, s.end)}


def test_passages(spark):
    rng = random.Random(2)
    shared, common = words(rng, 70, 5000), words(rng, 20, 5000)
    fuzzy = list(shared)
    for i in (12, 30, 31, 55):
        fuzzy[i] = "edited"
    del fuzzy[40]

    def doc(*parts):
        return " ".join(w for p in parts for w in p)

    def fill(n):
        return words(rng, n, 100_000)

    rows = [(i, doc(fill(60), common, fill(60))) for i in range(40)]  # a short line in all of them
    rows += [(100, doc(fill(30), shared, fill(50))), (101, doc(fill(90), fuzzy)), (102, doc(shared, fill(20)))]
    rows += [(200, doc(long := fill(80))), (201, doc(long).replace(" ", "\n")), (202, "short copy"), (203, "short copy"), (204, None), (205, "")]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {100, 101, 102, 200, 201}
    assert {got[d].class_id for d in (100, 101, 102)} == {100} and got[100].n_links == 2
    assert got[201].copy_of == 200 and got[201].repeated_words == 80
    assert len(spans_of(got[100]) ^ set(range(30, 100))) <= 4
    assert len(spans_of(got[102]) ^ set(range(70))) <= 4
    assert len(spans_of(got[101]) ^ set(range(90, 159))) <= 4


def test_passage_around_a_hot_line(spark):
    """Two documents share a passage that has a line of very many documents in it."""
    rng = random.Random(3)
    line, around = words(rng, 30, 5000), words(rng, 40, 5000)

    def fill(n):
        return words(rng, n, 100_000)

    rows = [(i, " ".join(fill(40) + line + fill(40))) for i in range(60)]
    rows += [(100, " ".join(fill(40) + around[:20] + line + around[20:] + fill(30))), (101, " ".join(fill(10) + around[:20] + line + around[20:]))]
    got = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {100, 101}


def test_passages_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert passages.repeated_passages(empty).count() == 0
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, 1), (7, text, 2), (7, text, 3), (8, "the " * 500, 4)], "doc_id long, text string, pivot int")
    got = passages.repeated_passages(docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == [7, 7, None] and {r.copy_of for r in got} == {7} and {r.class_id for r in got} == {7}
    rng = random.Random(5)
    p, q = " ".join(words(rng, 70, 5000)), " ".join(words(rng, 70, 5000))
    rows = [(3, p), (7, p), (7, f"x {q} y"), (9, f"z z {q}"), (None, f"a {q} b c"), (None, "alone " * 3), (-1, " ".join(words(rng, 80, 5000)))]
    got = sorted(((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert [g[:3] for g in got] == sorted([(3, 3, 3), (7, 3, 3), (7, 7, 7), (9, 7, 9), (None, 7, None)], key=str)
    assert all((n > 0) == (c == 7) for _, c, _, n in got)
    long = " ".join(words(rng, 60_000, 50_000))
    many = passages.repeated_passages(spark.createDataFrame([(1, long), (2, f"{long} end"), (3, "x " + long[: len(long) // 2])], DOCS)).collect()
    assert {r.class_id for r in many} == {1} and len(many) == 3


@pytest.mark.parametrize("seed", range(30))
def test_chains_like_brute_force(seed):
    """The best chain's score is that of a quadratic search; every match is in one chain."""
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
    a, p = np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])
    found = passages.chains(a, p)
    assert sorted(i for c in found for i in c.tolist()) == list(range(len(pairs)))
    for c in found:
        assert (np.diff(a[c]) > 0).all() and (np.diff(p[c]) > 0).all()
    score = []
    for i, (x, y) in enumerate(pairs):
        score.append(passages.K + max([0.0] + [score[j] - passages.GAP_COST * (x + y - u - v) for j, (u, v) in enumerate(pairs[:i]) if u < x and v < y]))
    best = max(passages.K * len(c) - passages.GAP_COST * (a[c][-1] - a[c][0] + p[c][-1] - p[c][0]) for c in found)
    assert best <= max(score) + 1e-9
    if all(max(np.diff(a[c]).max(initial=0), np.diff(p[c]).max(initial=0)) <= passages.MOST_GAP + passages.K for c in found):
        assert best == pytest.approx(max(score))


@pytest.mark.parametrize("blocks", [(30, 8, 30), (45, 12, 45), (49, 13, 49), (20, 3, 20, 4, 20), (45, 12, 33, 16, 45), (48,), (30, 20, 30)])
def test_stretches_of_block_edits(blocks):
    """Blocks of equal and of replaced words in turn: what stretches of 50 words and 0.8 cover, like brute force."""
    rng = random.Random(sum(blocks))
    same = np.concatenate([rng.choices([True, False], [1, 15], k=60), *(np.full(n, i % 2 == 0) for i, n in enumerate(blocks)), rng.choices([True, False], [1, 15], k=60)])
    n, total = len(same), np.r_[0, np.cumsum(same)]
    every = [(s, e) for s in range(n) for e in range(s + 50, n + 1) if same[s] and same[e - 1] and 5 * (total[e] - total[s]) >= 4 * (e - s)]
    x, y = np.arange(n), np.where(same, np.arange(n), -1)
    at = np.array([60])
    got = passages.align(x, y, at, at)
    assert all((s, e) in every and not any((u < s and v >= e) or (u <= s and v > e) for u, v in every) for s, e, *_ in got)
    assert {i for s, e, *_ in got for i in range(s, e)} == {i for s, e in every for i in range(s, e)}
    assert bool(got) or blocks in ((48,), (30, 20, 30))


@pytest.mark.parametrize("seed", range(5))
def test_hopeful_like_brute_force(seed):
    """Diagonals with a stretch of 20 columns and a score of 0 or more, windows of many sizes at once."""
    rng = np.random.default_rng(seed)
    xs = [rng.integers(0, 2 if k % 2 else 9, rng.integers(1, 90)).astype(np.uint32) for k in range(200)]
    ys = [np.where(rng.random(len(x)) < rng.random() ** 2, 99, x).astype(np.uint32)[: rng.integers(1, 90)] for x in xs]
    i, j = (np.array([rng.integers(len(v)) for v in vs]) for vs in (xs, ys))
    x_len, y_len = (np.array([len(v) for v in vs]) for vs in (xs, ys))
    got = passages.hopeful(np.concatenate(xs), np.cumsum(x_len) - x_len, x_len, np.concatenate(ys), np.cumsum(y_len) - y_len, y_len, i, j, 20)

    def brute(x, y, i, j):
        b = min(i, j)
        n = b + min(len(x) - i, len(y) - j)
        same = np.where(x[i - b : i - b + n] == y[j - b : j - b + n], 1, -4)
        return any(same[s:e].sum() >= 0 for s in range(n) for e in range(s + 20, n + 1))

    assert got.tolist() == [brute(*r) for r in zip(xs, ys, i.tolist(), j.tolist(), strict=True)]


def test_passage_with_a_replaced_block(spark):
    rng = random.Random(8)

    def fill(n):
        return words(rng, n, 100_000)

    a, b = fill(49), fill(49)
    rows = [(1, " ".join(fill(70) + a + fill(13) + b + fill(70))), (2, " ".join(fill(90) + a + fill(13) + b)), (3, " ".join(fill(200)))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got) == {1, 2}
    assert len(spans_of(got[1]) ^ set(range(70, 181))) <= 4 and len(spans_of(got[2]) ^ set(range(90, 201))) <= 4
    c = fill(60)
    beside = spark.createDataFrame([(4, " ".join(c + c + fill(40)))], "doc long, text string")
    assert [(r.start, r.end, r.pivot_start, r.pivot_end) for r in passages.passages(beside).collect()] == [(60, 120, 0, 60)]


@pytest.mark.parametrize("size, earlier", [(50, 46), (52, 48), (55, 45), (60, 48)])
def test_passage_whose_keys_stand_in_earlier_documents(spark, size, earlier):
    """Earlier documents share less than 50 words with two later ones that have the whole passage."""
    rng = random.Random(size)

    def fill(n):
        return words(rng, n, 100_000)

    rows = []
    for i in range(20):
        shared = fill(size)
        runs = [shared[s : s + earlier] for s in {*range(0, size - earlier, 3), size - earlier}] * 5
        rows += [(100 * i + k, " ".join(fill(40) + run + fill(40))) for k, run in enumerate(runs)]
        rows += [(100 * i + 90 + k, " ".join(fill(50) + shared + fill(30))) for k in range(2)]
    found = passages.passages(spark.createDataFrame(rows, "doc long, text string")).collect()
    got = {(r.doc, r.pivot) for r in found}
    assert {(100 * i + 91, 100 * i + 90) for i in range(20)} <= got


def test_fuzzy_passages_meet(spark):
    """Pairs with a passage of randomly replaced words, at least 0.85 alike, are all found, of those with 0.8 nearly all."""
    rng = random.Random(12)
    rows, pairs, hard = [], set(), set()
    for n in (50, 60, 100, 150):
        for percent in (5, 10, 15, 20):
            for _ in range(4):
                base = words(rng, n, 100_000)
                edited = list(base)
                for i in rng.sample(range(1, n - 1), n * percent // 100):
                    edited[i] = f"new{rng.randrange(100_000)}"
                d = len(rows)
                rows += [(d + k, " ".join(words(rng, 40, 100_000) + part + words(rng, 60, 100_000))) for k, part in enumerate((base, edited))]
                (hard if percent == 20 else pairs).add((d + 1, d))
    found = {(r.doc, r.pivot) for r in passages.passages(spark.createDataFrame(rows, "doc long, text string")).collect()}
    assert pairs <= found <= pairs | hard and len(found & hard) >= 0.8 * len(hard)


def test_edited_passage_of_lines_that_all_stand_in_earlier_documents(spark):
    """Each key of the passage has more members than are all matched, and its first one is in a document without the passage."""
    rng = random.Random(5)

    def fill(n):
        return words(rng, n, 100_000)

    lines = [fill(10) for _ in range(6)]
    rows = [(12 * i + k, " ".join(fill(40) + line + fill(40))) for i, line in enumerate(lines) for k in range(12)]
    edited = [[f"new{i}", *line[1:]] for i, line in enumerate(lines)]
    rows += [(100 + k, " ".join(fill(40) + sum(own, []) + fill(50))) for k, own in enumerate((lines, edited))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {100: (100, 1), 101: (100, 1)}


@pytest.mark.parametrize("seed", range(20))
def test_likely_loses_no_stretch(seed):
    """Stretches of 50 words around a k-mer with 10 replaced, inserted or left out."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 50).astype(np.uint64)
    at = int(rng.integers(0, 46))
    other, where = [], None
    changed = set(rng.choice([i for i in range(50) if not at <= i < at + 5], 10, replace=False).tolist())
    for i, w in enumerate(base):
        where = len(other) if i == at else where
        kind = rng.integers(0, 3) if i in changed and seed % 2 else 0
        other += [w] if i not in changed else [[rng.integers(1, 1 << 60)], [], [w, rng.integers(1, 1 << 60)]][kind]
    rows = []
    for text, place in ((base, at), (np.array(other, np.uint64), where)):
        full = np.concatenate([rng.integers(1, 1 << 60, 60).astype(np.uint64), text, rng.integers(1, 1 << 60, 60).astype(np.uint64)])
        rows.append(passages.surroundings(full, np.array([0]), np.array([len(full)]), np.array([60 + place]), 45)[0])
    assert len(passages.likely(*rows, 50)[0]) == 1
    assert len(passages.likely(rows[0], (rows[0] + 7) % 1024, 50)[0]) == 0


@pytest.mark.parametrize("seed", range(20))
def test_signs_lose_no_stretch(seed):
    """Stretches of 50 words around a k-mer with 10 replaced, inserted or left out have a sign in common; other surroundings have none."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 30 if seed % 4 < 2 else 1000, 50)
    at = int(rng.integers(0, 46))
    changed = set(rng.choice([i for i in range(50) if not at <= i < at + 5], 10, replace=False).tolist())
    other, where = [], None
    for i, w in enumerate(base):
        where = len(other) if i == at else where
        kind = rng.integers(0, 3) if i in changed and seed % 2 else 0
        other += [w] if i not in changed else [[rng.integers(1000, 2000)], [], [w, rng.integers(1000, 2000)]][kind]
    rows = []
    for text, place in ((base, at), (np.array(other), where)):
        full = np.concatenate([rng.integers(2000, 60_000, 60), text, rng.integers(2000, 60_000, 60)])
        rows.append(np.concatenate([full[60 + place - 45 : 60 + place][::-1], full[65 + place : 110 + place]]).astype(np.uint16))
    one, two = (set(r[r > 0].tolist()) for r in passages.signs(np.array(rows), 50))
    assert one & two
    # few words around, too few for a passage: none
    rows[0][40:] = 0
    rows[0][:10] = 0
    assert not passages.signs(np.array(rows), 50)[0].any()


def test_rows_of_one_word_meet_by_their_beginnings(spark, monkeypatch):
    """Documents with a row of one word: matches are a few for each two, not the square of the row's length."""
    rng = random.Random(6)
    rows = [(d, " ".join(words(rng, 60, 100_000) + ["the"] * 42 + words(rng, 60, 100_000))) for d in range(12)]
    texts = spark.createDataFrame(rows, "doc long, text string")
    met = []

    def kept(texts, matches, *_):
        met.append(matches.count())
        return spark.createDataFrame([], passages.FOUND)

    members = passages._members(passages._keys(texts, 50))
    monkeypatch.setattr(passages, "_aligned_matches", kept)
    passages._across(texts, members, spark.createDataFrame([], "doc long, root long"), 50)
    assert 66 <= met[0] <= 66 * 42 * 4


@pytest.mark.parametrize("seed", range(20))
def test_in_place_tells_order(seed):
    """Stretches of 50 words around a k-mer with 10 replaced, inserted or left out stay; the same words in another order go."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 50).astype(np.uint64)
    at = int(rng.integers(0, 46))
    changed = set(rng.choice([i for i in range(50) if not at <= i < at + 5], 10, replace=False).tolist())
    other, where = [], None
    for i, w in enumerate(base):
        where = len(other) if i == at else where
        kind = rng.integers(0, 3) if i in changed and seed % 2 else 0
        other += [w] if i not in changed else [[rng.integers(1, 1 << 60)], [], [w, rng.integers(1, 1 << 60)]][kind]
    noise = [rng.integers(1, 1 << 60, 60).astype(np.uint64) for _ in range(4)]
    texts = [np.concatenate([noise[0], base, noise[1]]), np.concatenate([noise[2], np.array(other, np.uint64), noise[3]])]
    left, right = texts[0][15 + at : 60 + at], texts[0][65 + at : 110 + at]
    texts.append(np.concatenate([left[:22][::-1], left[22:][::-1], base[at : at + 5], right[:23][::-1], right[23:][::-1]]))
    places = [60 + at, 60 + where, 45]
    near = np.concatenate([passages._around(t, np.array([0]), np.array([len(t)]), np.array([p]), 45)[0] for t, p in zip(texts, places, strict=True)])
    one, two = np.array([0, 1, 0]), np.array([1, 0, 2])
    assert passages.in_place(near, near, one, two, 50).tolist() == [True, True, False]
    buckets = passages._buckets(near)
    assert len(passages.likely(buckets[:1], buckets[2:], 50)[0]) == 1


def test_links_within_one_class_are_all_counted(spark):
    """Texts that are all made from one, each with edits of its own: every two share a passage, though no key leads from one to the other."""
    rng = random.Random(9)
    base, rows = words(rng, 150, 100_000), []
    for d in range(14):
        own = list(base)
        for i in rng.sample(range(150), 8):
            own[i] = f"new{rng.randrange(100_000)}"
        if d % 3 == 1:
            own[70:70] = words(rng, 3, 100_000)
        rows.append((d, " ".join(words(rng, 40, 100_000) + own + words(rng, 40, 100_000))))
    # one that has no passage with the first, but with those that have its edits
    half = list(base)
    for i in range(2, 150, 4):
        half[i] = f"odd{i}"
    rows += [(100 + k, " ".join(words(rng, 30, 100_000) + [f"x{k}" if i == 75 + k else w for i, w in enumerate(half)])) for k in range(10)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[d].n_links for d in range(14)] == [13] * 14
    assert [got[100 + k].n_links for k in range(10)] == [9] * 10
    assert {got[d].class_id for d in range(14)} == {0} and {got[100 + k].class_id for k in range(10)} == {100}
