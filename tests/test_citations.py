"""Citation lookup with and without a moving context, hyphens and chunks against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fuzzy
from palimpsest.operators import chunks, citations, texts


def corpus(rng):
    words = [f"termo{i}" for i in range(60)]
    rows = [(f"b{i % 3}", i // 3 + 1, " ".join(rng.choices(words, k=rng.randrange(3, 25))), i // 12 + 1) for i in range(150)]
    return rows, words


def paragraphs(rng, rows, words):
    out = []
    for doc in range(4):
        at, paras = rng.randrange(len(rows)), []
        for n in range(9):
            kind = rng.random()
            text = rows[min(at + 3 * n, len(rows) - 1)][2].split()
            if kind < 0.3:
                text = [w if rng.random() < 0.7 else rng.choice(words) for w in text]
            elif kind < 0.45:
                text = rng.choices(words, k=6)
            elif kind < 0.5:
                text = ["nada", "disso"]
            paras.append(paras[0] if kind > 0.95 and paras else " ".join(text))
        out += [(doc, n + 1, p) for n, p in enumerate(paras)]
    return out


def tokens(s, most):
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", s) if len(w) >= 4 and w != "para"))[:most]


def one_by_one(rows, paras, follow):
    """The same rules in plain Python, over all entries in order."""
    entries = sorted(rows)
    index = {}
    for i, (_, _, t, _) in enumerate(entries):
        for w in tokens(t, 60):
            index.setdefault(w, []).append(i)

    def best(prefix, query, some):
        for i in some:
            if prefix and prefix in entries[i][2]:
                return i, 100.0
        size, asked, found = sum(map(str.isalnum, query)), set(tokens(query, 12)), None
        for i in some:
            t = entries[i][2]
            if sum(map(str.isalnum, t)) >= max(8, min(24, size // 4)) and (not asked or asked & set(tokens(t, 60))):
                s = fuzzy.partial(query, t, found[1] if found else 0.0)
                if s > (found[1] if found else 0.0):
                    found = (i, s)
        return found

    def wide(query):
        hits, first = {}, {}
        for n, w in enumerate(tokens(query, 12)):
            for i in index.get(w, []):
                hits[i] = hits.get(i, 0) + 1
                first.setdefault(i, n)
        return sorted(hits, key=lambda i: (-hits[i], abs(len(entries[i][2]) - len(query)), first[i], i))[:1200]

    out, last, seen = [], None, {}
    for doc in sorted({p[0] for p in paras}):
        last, seen = None, {}
        for _, n, text in sorted(p for p in paras if p[0] == doc):
            prefix, query = text[:120].strip(), text[:200].strip()
            if text not in seen:
                if last is None or not follow:
                    found = next(((i, 100.0) for i in range(len(entries)) if prefix in entries[i][2]), None) or best(prefix, query, wide(query))
                else:
                    file, ref = entries[last][0], entries[last][3]
                    own = [i for i, e in enumerate(entries) if e[0] == file]
                    found = best(prefix, query, [i for i in own if ref - 2 <= entries[i][3] <= ref + 3] or own)
                    if found is None or found[1] < 70:
                        other = best(prefix, query, wide(query))
                        if found is None or (other and other[1] > found[1]):
                            found = other
                seen[text] = found
            found = seen[text]
            last = found[0] if found else last
            out.append((doc, n, *(entries[found[0]][:2] if found else (None, None)), round(found[1], 6) if found else 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lookup_and_follow_like_plain_python(spark, seed):
    rng = random.Random(seed)
    rows, words = corpus(rng)
    paras = paragraphs(rng, rows, words)
    entries = citations.entries(spark.createDataFrame(rows, "file string, at int, text string, page int"), "file", "at", "text", F.col("page"))
    index = citations.postings(entries)
    asked = spark.createDataFrame(paras, "doc_id int, ordinal int, paragraph string")
    got = citations.follow(asked, entries, index).collect()
    assert sorted((r.doc_id, r.ordinal, r.file, r.ordem, round(r.similarity, 6)) for r in got) == one_by_one(rows, paras, True)
    alone = citations.lookup(citations.asked(asked.withColumn("k", F.struct("doc_id", "ordinal")), "k", "paragraph"), entries, index, "k").collect()
    made = sorted((r.k.doc_id, r.k.ordinal, *(r.entry_id or (None, None)), round(r.similarity, 6)) for r in alone)
    assert made == one_by_one(rows, paras, False)


def test_window_without_neighbours_is_the_file(spark):
    entries = citations.entries(spark.createDataFrame([("a", 1, "um"), ("a", 50, "dois"), ("b", 1, "tres")], "file string, at int, text string"), "file", "at", "text")
    m = spark.createDataFrame([(1, "a", 1), (2, "a", 20), (3, "c", 1)], "k int, file string, reference int")
    assert sorted((r.k, r.entry_id.ordem) for r in citations.window(m, entries).collect()) == [(1, 1), (2, 1), (2, 50)]




def plain_hyphens(text):
    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    count = 0

    def put(m):
        nonlocal count
        if m[1].lower() in set(texts.KEEP_HYPHEN) or len(m[2]) <= 2:
            return m[0]
        count += 1
        return m[1] + m[2]

    made = re.sub(rf"\b([{letters}]{{2,}})-([{letters}]{{2,}})\b", put, text)
    return made, count


def test_hyphens_like_plain_python(spark):
    rng = random.Random(4)
    parts = ["auto", "pala", "vra", "a", "x1", "Pré", "ção", "co", "ÉTICA", "bem", "de", "_u", "vice", "tora"]
    rows = ["".join(rng.choice(parts) + rng.choice(["-", "-", " ", ", ", "--"]) for _ in range(12)) for _ in range(300)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(texts.joined_hyphens(F.col("t")), texts.hyphens(F.col("t"))).collect()
    assert [tuple(g) for g in got] == [plain_hyphens(r) for r in rows]


def test_lines_across_hyphens(spark):
    rows = [(1, 1, "uma pala-"), (1, 2, "vra inteira"), (1, 3, "Fim-"), (1, 4, "Outra"), (2, 1, "a-"), (2, 2, "bc d")]
    got = texts.joined_lines(spark.createDataFrame(rows, "k int, place int, line string"), "k").orderBy("k", "place").collect()
    assert [r.joined for r in got] == ["uma palavra", " inteira", "Fim-", "Outra", "a-", "bc d"]
    items = texts.numbered_items(spark.createDataFrame([(1, i, f"{i}) item" if i % 2 else "item") for i in range(1, 12)], "k int, place int, line string"), "k", "normal_single").orderBy("place").collect()
    assert items[0].item == "01. item" and items[10].item == "11. item"


def test_rules_headers_and_marks(spark):
    lines = ["--------", "-------", "- - - - ~~", "12", "(12) |", "12 3 45", "Grande Livro de Termos", "Grande Livro de Termos e mais ainda", "texto"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "k int, place int, line string")
    assert [r.place for r in texts.without_rules(df).orderBy("place").collect()] == [1, 3, 4, 5, 6, 7, 8]
    assert [r.place for r in texts.without_headers(df, ["grande", "termo"]).orderBy("place").collect()] == [0, 1, 2, 5, 7, 8]
    one = spark.createDataFrame([("Ação e reacao, AÇÃO",)], "t string").select(texts.highlighted_folded(F.col("t"), ["acao", "e r"])).first()[0]
    assert one == "<mark>Ação</mark> <mark>e r</mark>e<mark>acao</mark>, <mark>AÇÃO</mark>"
    lists = spark.createDataFrame([("1; 2,,3 ", "a;b\nc")], "p string, t string").select(texts.page_list(F.col("p")), texts.titles(F.col("t")), texts.shortened(F.lit("abcdefgh"), 6)).first()
    assert tuple(lists) == ("1, 2, 3", ["a", "b", "c"], "abc...")


def plain_chunks(text, target, most, least):
    """The packing rule, sentence by sentence, over the parts."""
    out = []
    for part in re.split(r"\n\s*\n+|\s\|\s|[•·]", text):
        if not (part := part.strip()):
            continue
        sentences = [s.strip() for s in re.split(r"(?<=[.!?:;])\s+", part) if s.strip()]
        if len(" ".join(sentences)) <= most:
            out.append(" ".join(sentences))
            continue
        now = ""
        for s in sentences:
            whole = (now + " " + s).strip()
            if len(s) <= most and len(whole) <= target or len(s) <= most and not now:
                now = whole
                continue
            if now:
                out.append(now)
            now = s if len(s) <= most else ""
            if len(s) > most:
                out += chunks._pieces(s, most)
        if now:
            out.append(now)
    merged = []
    for c in out:
        if merged and len(c) < least and len(merged[-1]) + 1 + len(c) <= most:
            merged[-1] += " " + c
        else:
            merged.append(c)
    return merged if len(text) > most else [text] * bool(text)


def test_chunks_like_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        parts = [" ".join(" ".join(rng.choices(["alfa", "beta,", "gama", "x"], k=rng.randrange(1, 40))) + rng.choice(".!?;:") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 4))]
        rows.append((i, rng.choice(["\n\n", " | ", " • "]).join(parts)))
    got = {}
    for r in chunks.chunked(spark.createDataFrame(rows, "id int, text string"), "id").collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.chunk
    assert {i: [c[k] for k in sorted(c)] for i, c in got.items()} == {i: plain_chunks(t, 280, 420, 110) for i, t in rows}


def test_rechunked_rows(spark):
    long = " ".join(f"frase numero {i} com texto." for i in range(60))
    rows = [(5, "**curto** aqui", "curto aqui", {"title": "T", "author": "A"}), (6, long, long, {"title": "T", "chunk_total": "x"}), (7, " ", None, None)]
    got = chunks.rechunked(spark.createDataFrame(rows, "row int, text string, text_plain string, metadata map<string,string>"), "EC").collect()
    short = [r for r in got if r.row == 5]
    assert len(short) == 1 and short[0].text == "**curto** aqui" and short[0].text_plain == "curto aqui" and short[0].embedding_text == "EC | T | A | curto aqui" and short[0].metadata == {"title": "T", "author": "A"}
    parts = sorted((r for r in got if r.row == 6), key=lambda r: int(r.metadata["chunk_index"]))
    assert len(parts) > 1 and all(r.metadata["chunk_total"] == str(len(parts)) and r.metadata["source_row"] == "6" for r in parts) and not [r for r in got if r.row == 7]
    assert [int(r.metadata["chunk_index"]) for r in parts] == list(range(1, len(parts) + 1)) and parts[0].embedding_text.startswith("EC | T | frase numero 0")


def zipf_entries(spark, n, rng, frequent=40):
    """Entries of words of which few stand nearly everywhere and many stand in a few entries."""
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [("b", i, " ".join(rng.choices(words, weights, k=rng.randrange(5, frequent)))) for i in range(n)]
    e = citations.entries(spark.createDataFrame(rows, "f string, i long, t string"), "f", "i", "t")
    return rows, e, citations.postings(e)


def plain_candidates(rows, text, most):
    words = lambda t, k: list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", t) if len(w) >= 4 and w != "para"))[:k]
    asked = words(text[:200], citations.QUERY_TOKENS)
    found = []
    for _, i, t in rows:
        own = set(words(t, citations.ENTRY_TOKENS))
        if hits := sum(w in own for w in asked):
            found.append((-hits, abs(len(t) - len(text[:200].strip())), next(k for k, w in enumerate(asked) if w in own), i))
    return [(i, -h) for h, _, _, i in sorted(found)[:most]]


@pytest.mark.parametrize("most", [1, 4, 30, 5000])
def test_candidates_like_all_pairs(spark, monkeypatch, most):
    rng = random.Random(most)
    rows, e, index = zipf_entries(spark, 300, rng)
    texts = [(k, rows[k][2] if k % 2 else " ".join(rng.choice(rows)[2].split()[:4])) for k in range(12)] + [(50, "nothing shared"), (51, "")]
    asked = citations.asked(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    for sets, worth in ((None, 1.0), (citations.entry_sets(e), 1.0), (None, 0.0)):
        monkeypatch.setattr(citations, "WORTH", worth)
        got = {}
        for r in citations.candidates(asked, index, "k", most, sets).orderBy("k", "place").collect():
            got.setdefault(r.k, []).append((r.entry_id.ordem, r.hits))
        assert got == {k: c for k, t in texts if (c := plain_candidates(rows, t, most))}


def test_few_of_the_pairs_are_met(spark):
    """Queries with rare words and words that stand everywhere: less than a tenth of the postings are read."""
    rng = random.Random(2)
    rows = [("b", i, f"everywhere always common{i % 3} rare{i // 40} {'filler ' * rng.randrange(30)}") for i in range(3000)]
    e = citations.entries(spark.createDataFrame(rows, "f string, i long, t string"), "f", "i", "t")
    index = citations.postings(e)
    texts = [(k, f"everywhere always common{k % 3} rare{k}") for k in range(5)]
    asked = citations.asked(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    ranked = citations._ranked_tokens(asked, citations.token_counts(index), "k", 8).cache()
    found = citations._judged(citations.met_first(ranked, index, "k").distinct(), citations.entry_sets(e), asked, "k").cache()
    read = citations.met_first(ranked, index, "k").count() + citations.met_then(ranked, index, found, "k", 8).count()
    assert read * 10 < ranked.join(index, "token").count()
    got = {}
    for r in citations.candidates(asked, index, "k", 8).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.entry_id.ordem, r.hits))
    assert got == {k: plain_candidates(rows, t, 8) for k, t in texts}


def test_ranges_meet_their_bins_only(spark):
    """What an ask meets grows with its range, not with its file; results are those of the range."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, "text", rng.randrange(2000)) for i in range(4000)]
    e = citations.entries(spark.createDataFrame(rows, "f string, i long, t string, p long"), "f", "i", "t", F.col("p"))
    asks = [(k, rng.choice("ab"), rng.randrange(2000)) for k in range(40)]
    m = spark.createDataFrame(asks, "k int, file string, reference long")
    for before, after in ((0, 0), (2, 3), (7, 1)):
        got = {}
        for r in citations.around(m, citations.binned(e, citations.width_of(before, after)), before, after).select("_m.k", "entry_id").collect():
            got.setdefault(r.k, set()).add(r.entry_id.ordem)
        assert got == {k: s for k, f, p in asks if (s := {i for g, i, _, q in rows if g == f and p - before <= q <= p + after})}
        plan = citations.around(m, citations.binned(e, citations.width_of(before, after)), before, after)._jdf.queryExecution().optimizedPlan().toString()
        join = next(line for line in plan.splitlines() if "Join" in line)
        assert "_bin" in join and "_file" in join


def exchanged(df):
    """What a plan deals by shuffles of more than single rows."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_entries_stay_where_they_are(spark):
    """Queries go to entries and postings; neither is dealt anew for a few queries, and no table is made of all words."""
    rng = random.Random(8)
    rows, e, _ = zipf_entries(spark, 300, rng)
    sets = citations.entry_sets(e)
    texts = [(k, rows[k][2]) for k in range(12)]
    asked = citations.asked(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    met = citations.met_first(citations._ranked_tokens(asked, citations.token_counts(citations.postings(e)), "k", 8), citations.postings_of(sets), "k")
    assert not exchanged(met)
    assert met.count() == met.select("k", "entry_id").distinct().count()
    hits = citations.prefix_hits(asked, e, "k")
    assert all("k#" in line and "entry_id" not in line.partition("hashpartitioning")[2] and "word#" not in line for line in exchanged(hits))
    assert {r.k: r.entry_id.ordem for r in hits.collect()} == {k: min(i for _, i, x in rows if t[:120].strip() in x) for k, t in texts}


@pytest.mark.parametrize("worth", [0.0, 1.0])
def test_candidates_of_postings_with_words(spark, monkeypatch, worth):
    """Entries on several lists of a query, whole ones and blocks, are met once."""
    rng = random.Random(3)
    rows, e, index = zipf_entries(spark, 400, rng)
    sets = citations.entry_sets(e).cache()
    texts = [(k, " ".join(rng.choice(rows)[2].split()[:6])) for k in range(12)]
    asked = citations.asked(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    monkeypatch.setattr(citations, "WORTH", worth)
    for most in (2, 9, 60):
        got = {}
        for r in citations.candidates(asked, citations.postings_of(sets), "k", most, sets).orderBy("k", "place").collect():
            got.setdefault(r.k, []).append((r.entry_id.ordem, r.hits))
        assert got == {k: c for k, t in texts if (c := plain_candidates(rows, t, most))}


def test_tokens_of_long_texts(spark):
    """A beginning that has too few, or ends within a word or a run of short ones, is no end of the search."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["abcd", "para", "ab", "x1y2z3", "longerword", "é"]) + str(rng.randrange(3)) * rng.randrange(3) + rng.choice([" ", " ", ".", ""]) for _ in range(rng.randrange(2, 600)))) for i in range(300)]
    rows += [(900 + k, "w" * k + " para " + "q" * 30 + " tail") for k in range(citations.HEAD - 40, citations.HEAD + 5)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", *(citations.tokens(F.col("t"), m).alias(f"m{m}") for m in (1, 12, 60))).collect()
    for (_, t), r in zip(rows, sorted(got), strict=True):
        words = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", t) if len(w) >= 4 and w != "para"))
        assert [r.m1, r.m12, r.m60] == [words[:1], words[:12], words[:60]]


def test_a_text_is_normalised_once(spark):
    made = citations.entry_sets(citations.entries(spark.createDataFrame([("a", 1, "um dois três")], "f string, i long, t string"), "f", "i", "t"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
