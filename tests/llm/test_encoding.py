"""Sampled segmentations, fingerprints, media and language ID."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, ogg, parsing, pieces

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.VOCABULARY)


def paths(text, m, alpha=1.0):
    """All segmentations of a short text, with their log weights."""
    text = "▁" + text.replace(" ", "▁")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    out = []

    def walk(at, made, w):
        if at == len(text):
            out.append((tuple(made), w))
        for end in range(at + 1, len(text) + 1):
            if (i := ids.get(text[at:end])) is not None and "▁" not in text[at + 1 : end]:
                walk(end, [*made, i], w + alpha * m.log_p[i])

    walk(0, [], 0.0)
    total = math.log(sum(math.exp(w) for _, w in out))
    return {p: w - total for p, w in out}


def test_samples_follow_the_model(model):
    text, n = "cat in", 4000
    exact = paths(text, model)
    got = pieces.segmentations([text] * n, np.arange(n, dtype=np.uint64))
    count = {}
    for samples in got:
        ids = [tuple(np.frombuffer(s["ids"], np.int32).tolist()) for s in samples]
        assert len(set(ids)) == len(ids)
        for s, i in zip(samples, ids, strict=True):
            assert s["log_p"] == pytest.approx(exact[i], abs=2e-6)
        count[ids[0]] = count.get(ids[0], 0) + 1
    for p, w in exact.items():
        q = math.exp(w)
        assert abs(count.get(p, 0) / n - q) < 4.5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_inclusion_scores_are_unbiased(model):
    """Sums of f(segmentation) p / inclusion over the sample but for the threshold's have the mean of f as expectation."""
    text, n = "cat in", 4000
    exact = paths(text, model)
    mean = sum(math.exp(w) * len(p) for p, w in exact.items())
    got = pieces.segmentations([text] * n, np.arange(n, dtype=np.uint64), k=3)
    values = [sum(math.exp(s["log_p"] - s["log_inclusion"]) * s["pieces"] for s in samples) for samples in got]
    assert abs(np.mean(values) - mean) < 5 * np.std(values) / math.sqrt(n)


def test_segmentations_decode(spark):
    rng = random.Random(1)
    texts = ["", " ", "a", "naïve  café ▁ 漢字 🙂\n\t x", "the " * 300, "x" * 5000, " " * 200, None] + ["".join(rng.choice("ab c\né漢") for _ in range(rng.randrange(80))) for _ in range(30)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, samples string")
    rows = pieces.encode(docs.drop("samples"), ["doc_id", "text"], check=True)
    back = pieces.decode(rows.drop("exact"), ["doc_id", "text"]).collect()
    for r in back:
        assert r.decoded is None if r.text is None else r.decoded and set(r.decoded) == {r.text}
    assert all(r.exact is (None if r.text is None else True) for r in rows.collect())
    again = pieces.encode(docs.drop("samples").repartition(3), ["doc_id", "text"]).collect()
    assert {(r.text, str(r.samples)) for r in again} == {(r.text, str(r.samples)) for r in rows.collect()}


def fingerprints(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        (a, b, c), _ = parsing.sketches([x.encode() for x in (t, e, n)])
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, parsing.likeness(a, b), parsing.likeness(a, c))
    return out


def test_fingerprints_like_one_by_one(spark):
    rng = random.Random(5)
    rows = [(7 * i, "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 3, 50, 900, 4000])))) for i in range(60)] + [(1000, None), (1001, "x" * 10_000), (-4, "first")]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in parsing.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()}
    expected = fingerprints(rows)
    assert got.keys() == expected.keys()
    for d in got:
        assert got[d][:4] == expected[d][:4] and got[d][4:] == pytest.approx(expected[d][4:])


def test_equal_substrings_share_phrases():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b = (("".join(rng.choice("abcdefgh ") for _ in range(n)) + shared).encode() for n in (17, 400))
    other = "".join(rng.choice("abcdefgh ") for _ in range(3000)).encode()
    x, y, z = (set(p.tolist()) for p in parsing.parse([a, b, other])[1])
    assert len(x & y) / len(x | y) > 0.7 > 0.2 > len(x & z) / len(x | z)


def test_fingerprint_edges(spark):
    assert parsing.fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0
    one = parsing.fingerprint_edits(spark.createDataFrame([(5, "abcdefgh")], DOCS)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    two = parsing.fingerprint_edits(spark.createDataFrame([(None, "a", 1), (1, "a", 2)], "doc_id long, text string, bucket int")).collect()
    assert len(two) == 2 and len({r.fingerprint for r in two}) == 1


def test_ogg_round_trip(spark):
    texts = ["", None, "a", "é" * 500, "x" * 300_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in ogg.features(ogg.store(docs, ["doc_id"]), ["doc_id", "n_bytes"]).collect()}
    for i, t in enumerate(texts):
        n, padded = ogg.pad(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert len(padded) % 192 == 0 and padded
    assert got[2].media_sha256 == got[5].media_sha256 and got[2].feature == got[5].feature


def test_ogg_damage_is_seen():
    data = bytearray(ogg.write(b"payload " * 3000))
    assert ogg.read(bytes(data))[0] == b"payload " * 3000
    for at in (0, 5, 30, 200, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.read(bytes(bad))
    with pytest.raises(ValueError):
        ogg.read(bytes(data[:-5]))


def test_ogg_pages_by_hand():
    """Checksum by the polynomial bit by bit; packets over pages; times from granule positions."""
    page = ogg.write_stream(9, [(b"head", 0), (b"z" * 70_000, 70_000), (b"", 70_000)])[1]
    crc = 0
    for byte in page[:22] + bytes(4) + page[26:]:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert crc == int.from_bytes(page[22:26], "little")
    s = ogg.demultiplex(b"".join(ogg.write_stream(9, [(b"head", 0), (b"z" * 70_000, 70_000), (b"", 70_000)])))[9]
    assert [len(p.data) for p in s.packets] == [4, 70_000, 0] and s.ended and s.pages == 3
    assert s.packets[1].end_s == 70_000 / ogg.RATE


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where("not held_out"))
    got = langid.predict(docs, *model, keep=["doc_id", "held_out", "lang"]).where("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None), ("123", "zz")], "text string, lang string")
    langs, p = langid.train(train)
    assert langs == ["de", "en"]
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 ..", "a"), (4, "the mat", None), (5, "und die hund", "fr"), (6, "the mat " * 20_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langs, p, keep=["doc_id"]).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "en"}
    kept = langid.keep_known(docs, langs, p)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}
    assert langid.predict(docs.limit(0), langs, p).count() == 0
    assert langid.train(train.limit(0))[0] == [] and langid.keep_known(docs, *langid.train(train.limit(0))).count() == 0


ALL = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def plain_fingerprint(text):
    """Coin tossing over one text, name by name."""
    names, level, phrases = [plain_mix(b + 1) for b in text.encode()], 0, []
    if not names:
        return f"{0:016x}:"
    while True:
        if level <= parsing.LEVEL and (level == parsing.LEVEL or len(names) == 1):
            phrases = names
        if len(names) == 1:
            break
        runs = [(k, len(list(g))) for k, g in itertools.groupby(names)]
        names = [k if n == 1 else plain_mix((k + n * 0xD6E8FEB86659FD93) & ALL) for k, n in runs]
        labels = names
        for _ in range(4):
            made = []
            for i, x in enumerate(labels):
                differ = x ^ (labels[i - 1] if i else x ^ 1)
                at = (differ & -differ).bit_length() - 1
                made.append(2 * at + (x >> at & 1))
            labels = made
        n = len(labels)
        starts = [0] + [i for i in range(2, n - 1) if labels[i] < labels[i - 1] and labels[i] < labels[i + 1]] + [n]
        groups = [names[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
        names = [g[0] if len(g) == 1 else plain_mix((sum(x * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, x in enumerate(g)) + len(g)) & ALL) for g in groups]
        level += 1
    small = sorted({plain_mix(p) >> 32 for p in phrases})[: parsing.SKETCH]
    return f"{names[0]:016x}:" + "".join(f"{s:08x}" for s in small)


def test_fingerprints_like_plain_python():
    rng = random.Random(8)
    texts = ["", "a", "ab", "aaaa", "abab" * 9, "é漢🙂", "x" * 3000] + ["".join(rng.choice("ab c") for _ in range(rng.randrange(400))) for _ in range(60)]
    assert parsing.sketches([t.encode() for t in texts])[0] == [plain_fingerprint(t) for t in texts]


def test_ogg_file_by_plain_reader():
    """Pages, lacing and channels taken apart byte by byte, without the module's reader."""
    payload = bytes(range(256)) * 300
    data, at, streams = ogg.write(payload), 0, {}
    while at < len(data):
        assert data[at : at + 4] == b"OggS"
        serial, count = int.from_bytes(data[at + 14 : at + 18], "little"), data[at + 26]
        packets = streams.setdefault(serial, [b""])
        place = at + 27 + count
        for n in data[at + 27 : at + 27 + count]:
            packets[-1] += data[place : place + n]
            place += n
            if n < 255:
                packets.append(b"")
        at = place
    channels = {int.from_bytes(p[0][8:12], "little"): b"".join(p[1:]) for p in streams.values()}
    assert len(streams) == 2 and bytes(b for pair in zip(channels[0], channels[1], strict=True) for b in pair) == payload


def plain_vector(text):
    """Trigrams of letter classes bound and bundled one after the other."""
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, langid.DIM)).astype(int)
    kinds = [0]
    for c in text + " ":
        k = 0 if not c.isalpha() else ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % (langid.CLASSES - 27)
        if k or kinds[-1]:
            kinds.append(k)
    total = np.zeros(langid.DIM)
    for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total / np.sqrt(total @ total)


def test_language_id_like_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, p = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("out")).collect()
    vectors = {r.doc_id: plain_vector(r.text) for r in rows if any(map(str.isalpha, r.text or ""))}
    for k, lang in enumerate(langs):
        own = sum(np.rint(vectors[r.doc_id] * langid.UNIT) for r in rows if r.lang == lang and not r.out and r.doc_id in vectors)
        assert p[k] == pytest.approx(own / np.sqrt(own @ own))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langs, p, keep=["doc_id"]).collect()}
    for r in rows:
        scores = p @ vectors[r.doc_id] if r.doc_id in vectors else None
        lang, score = got[r.doc_id]
        assert (lang, score) == ("und", 0.0) if scores is None else score == pytest.approx(max(0, scores.max())) and lang == langs[int(scores.argmax())]


def test_short_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    lost = docs.join(langid.keep_known(docs, *model).select("doc_id"), "doc_id", "left_anti").collect()
    assert all(not any(map(str.isalpha, r.text or "")) for r in lost)


def test_long_units_like_enumeration(model):
    """A run without spaces that is longer than LONG: log probabilities of samples are those of its own lattice."""
    text = "ab" * 40
    longest = max(len(x.decode("utf-8", "ignore")) for x in model.bytes)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    whole = "▁" + text
    mass = [0.0] * len(whole) + [1.0]
    for at in range(len(whole) - 1, -1, -1):
        mass[at] = sum(math.exp(model.log_p[ids[whole[at:e]]]) * mass[e] for e in range(at + 1, min(len(whole), at + longest) + 1) if whole[at:e] in ids)
    for s in pieces.segmentations([text], np.zeros(1, np.uint64))[0]:
        made = np.frombuffer(s["ids"], np.int32)
        assert s["log_p"] == pytest.approx(sum(model.log_p[made]) - math.log(mass[0]), abs=1e-5)
    safe = model.cut("zq" * 50 + "漢字" * 50)
    assert "".join(safe) == "zq" * 50 + "漢字" * 50
    for t in ("=" * 3000, "漢" * 400, "a" * 20_000):
        two = pieces.segmentations([t], np.zeros(1, np.uint64))[0]
        assert len(two) == (1 if t[0] == "漢" else 2) and all(pieces.decode_ids(s["ids"], model) == t for s in two)


def test_kept_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "x", b"1", 5), (1, "a b", "x", b"1", 5), (None, None, None, None, None)], "doc_id long, text string, samples string, media binary, _text int")
    for run in (lambda keep: pieces.encode(docs, keep), lambda keep: ogg.store(docs, keep)):
        with pytest.raises(ValueError):
            run(["doc_id", "samples", "media"])
        rows = run(["doc_id", "_text"]).collect()
        assert len(rows) == 3 and sorted(map(str, rows))[1] == sorted(map(str, rows))[2] or sorted(map(str, rows))[0] == sorted(map(str, rows))[1]
        assert run(["doc_id"]).limit(0).count() == 0
    empty = docs.limit(0)
    assert pieces.encode(empty, ["doc_id"]).count() == ogg.features(ogg.store(empty, ["doc_id"]), ["doc_id"]).count() == parsing.fingerprint_edits(empty).count() == 0
    twice = parsing.fingerprint_edits(docs).collect()
    assert len(twice) == 3 and len({(r.fingerprint, r.n_chars) for r in twice if r.doc_id == 1}) == 1
