"""MinHash near-dedup with odd sketches.

Documents with the same set of shingles form a class and go on as one. Each class has 120 MinHash samples: 24 bands of
five find the candidates (two sets of Jaccard similarity 0.85 meet in no band with probability 8e-7), and an odd sketch,
a bitmap of the samples' parities, tells by the population count of an XOR which candidates are worth comparing in
full. Links are then confirmed on the full sets, computed again from the texts of the classes concerned.

A band's bucket is not expanded into pairs. Its members are compared with one of them, the pivot: that which has most
candidates in all its buckets, as the text has that a group's other members were copied from. Buckets of PIVOTS + 1
members at most are compared in full. So a group of thousands of near copies costs a star, not a square.

What then still stands apart in a bucket is dealt anew by an exact condition: two sets A and B as alike as asked for, t,
have c = ceil(t / (1 + t) (|A| + |B|)) shingles in common, so one of the rarest |A| - c + 1 of A is one of the rarest
|B| - c + 1 of B. What a copy was changed in makes shingles that few others have, and where these are too many it meets
nobody. As c depends on both sizes, buckets are for sizes in steps of SIZE_STEP too, those of the smaller set. Groups of
sets that are left connected are compared in blocks of bounded size against blocks, each as a matrix product, but for
blocks that one component has for itself; a pair of blocks emits a spanning forest of its links. No candidate is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed, in_small_batches, sized, steps
from palimpsest.llm.components import components
from palimpsest.llm.shingles import K, digest, scramble, shingle_hashes, word_hashes

BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Candidates whose estimated similarity is lower by so much than asked for go no further (4.7 standard deviations).
MARGIN = 0.17
#: Buckets with one member more are compared in full.
PIVOTS = 8
#: Sets, and bytes of them, in a block.
BLOCK_SETS, BLOCK_BYTES = 512, 8 << 20
SIZE_STEP = 1.02

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SAMPLES): the smallest value of each hash function over each set, none of them empty."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), 1))
    for r in range(ROWS):
        keys = scramble(keys + mins[:, r::ROWS])
    return keys.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(sets, words): each sample flips the bit that it and its number hash to."""
    at = scramble(mins ^ (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(40))) % np.uint64(SKETCH_BITS)
    bits = np.zeros((len(mins), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.repeat(np.arange(len(mins)), SAMPLES), at.ravel().astype(np.int64)), 1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets by their odd sketches: with z differing bits of n, 1 + n / (4 k) ln(1 - 2 z / n)."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    rest = 1 - 2 * apart / SKETCH_BITS
    return F.when(rest > 0, 1 + SKETCH_BITS / (4 * SAMPLES) * F.ln(rest)).otherwise(F.lit(0.0))


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands, sketch; the last three null for a text without words."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
        for ids, sets in _sets(batches, k):
            full = [s for s in sets if len(s)]
            mins = min_hashes(full) if full else np.zeros((0, SAMPLES), np.uint64)
            bands, odd = iter(band_keys(mins).tolist()), iter(odd_sketches(mins).tolist())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(bands) if len(s) else None for s in sets], schema.field("bands").type), pa.array([next(odd) if len(s) else None for s in sets], schema.field("sketch").type)],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _sets(batches, k: int):
    """(ids, sorted shingle sets) of a few MB of texts at a time."""
    for b in batches:
        texts = b["text"]
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) and pa.types.is_string(texts.type) else [len(t or "") for t in texts.to_pylist()]
        for a, z in steps(sizes.tolist() if isinstance(sizes, np.ndarray) else sizes):
            words, at = word_hashes(texts[a:z].to_pylist())
            yield b["doc_id"][a:z], [np.unique(shingle_hashes(words[at[i] : at[i + 1]], k)) for i in range(z - a)]


def _full_sets(docs: DataFrame, wanted: DataFrame, rows: int, k: int) -> DataFrame:
    """(node, full) of the classes wanted (node, rep, digest): the sorted set, eight bytes a shingle."""
    ids = checkpointed(wanted.select(F.col("rep").alias("_id")).distinct(), rows)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    some = docs.select("doc_id", "text").join(sized(ids, ids.count()), same, "left_semi")

    def run(batches):
        for _, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "full"])

    # rows that repeat a doc_id, or its text, give a set that is not wanted, or one twice
    made = some.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "digest binary, full binary")
    return made.join(sized(wanted.select("node", "digest"), rows), "digest").select("node", "full").dropDuplicates(["node"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of (node, full) that share one of their rarest shingles: each with the first that has it.

    Any two sets with 100 |A & B| >= percent |A | B| are linked in this way, by way of others or not.
    """

    def run(batches):
        for b in batches:
            for node, full in zip(b["node"].to_pylist(), b["full"].to_pylist(), strict=True):
                tokens = np.frombuffer(full, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), node, np.int64)), pa.array(np.full(len(tokens), len(tokens), np.int64))], ["band", "node", "total"])

    tokens = sets.mapInArrow(run, "band long, node long, total long")
    often = tokens.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(often, "band").groupBy("node").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("n", "band"))).alias("by"))

    def step(size: Column) -> Column:
        return F.floor(F.ln(size.cast("double")) / F.lit(math.log(SIZE_STEP))).cast("int")

    least = F.ceil(F.col("total") * percent / 100)  # size of the smallest partner
    dealt = shared.withColumn("step", F.explode(F.sequence(step(least), step(F.col("total")))))
    smaller = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("step"))) - 1)
    common = F.ceil(percent * (smaller + F.col("total")) / (100 + percent))
    # shingles that no other set has come first in the order, and lead nowhere
    rare = F.col("total") - common + 1 - (F.col("total") - F.size("by"))
    found = dealt.where(rare > 0).select("node", "step", F.explode(F.slice("by", F.lit(1), rare.cast("int"))).alias("x"))
    found = checkpointed(found.select(F.xxhash64("x.band", "step").alias("band"), "node"))
    firsts = found.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    return found.join(firsts, "band").where("node != b").select(F.col("node").alias("a"), "b")


def _block_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected among the sets (node, full, group, root) of each group.

    Roots of a quarter of a block or more have blocks of their own, the others share blocks; two blocks of one root are
    connected already and not compared. So a group costs what is not yet linked times its size.
    """
    per = sets.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum(F.length("full")).alias("size"))
    own = (F.col("n") >= BLOCK_SETS // 4) | (F.col("size") >= BLOCK_BYTES // 4)
    labels = checkpointed(per.select("group", "root", "n", "size", F.when(own, F.col("root")).alias("label")))
    blocks = labels.groupBy("group", "label").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    open_ = labels.groupBy("group").agg(F.count("*").alias("roots")).where("roots > 1").select("group")
    # a group has as many blocks as its sets fill
    parts_of = blocks.join(open_, "group").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("label", "blocks"))).alias("parts"))
    every = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda i: F.struct(p["label"].alias("label"), i.alias("i")))))
    dealt = sets.join(labels.select("group", "root", "label"), ["group", "root"]).join(parts_of.select("group", every.alias("all")), "group")
    mine = F.filter("all", lambda b: b["label"].eqNullSafe(F.col("label")))
    dealt = dealt.withColumn("at", F.get(mine, F.pmod(F.xxhash64("node"), F.size(mine)).cast("int")))
    # a block of shared ones is compared with itself too
    others = F.filter("all", lambda b: b["label"].isNull() | ~b["label"].eqNullSafe(F.col("label")))
    dealt = dealt.select("group", "node", "full", "at", F.explode(others).alias("other"))
    order = F.array_sort(F.array("at", "other"))
    dealt = dealt.select("group", order[0].alias("i"), order[1].alias("j"), (order[0] == F.col("at")).alias("first"), "node", "full")
    keys = ["group", "i", "j"]

    def run(batches):
        key, held = None, []

        def out():
            pairs = _forest([(r["node"], r["first"], np.frombuffer(r["full"], np.uint64)) for r in held], key[1] == key[2], percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for row in b.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if held:
                        yield out()
                    key, held = now, []
                held.append(row)
        if held:
            yield out()

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _forest(rows: list[tuple[int, bool, np.ndarray]], whole: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect the linked ones among rows (node, in the first block, set); without `whole` only across blocks."""
    size = np.array([len(r[2]) for r in rows])
    who = np.repeat(np.arange(len(rows)), size)
    kind, often = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)[1:]
    shared = often > 1
    number = np.cumsum(shared) - 1
    who, kind = who[shared[kind]], number[kind[shared[kind]]]
    order = np.argsort(kind, kind="stable")
    who, kind = who[order], kind[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for c in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(kind, [c, c + 4096])
        m = np.zeros((len(rows), 4096), np.float32)
        m[who[x:y], kind[x:y] - c] = 1
        both += m @ m.T
    both = np.rint(both).astype(np.int64)
    near = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    if not whole:
        first = np.array([r[1] for r in rows])
        near &= first[:, None] != first[None, :]
    top, out = list(range(len(rows))), []

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for a, b in np.argwhere(near).tolist():
        x, y = find(a), find(b)
        if x != y:
            top[x] = y
            out.append((rows[a][0], rows[b][0]))
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 |A & B| >= percent |A | B| on the full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("full").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("full").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    A document's set is its distinct k-word shingles (A-Z lower-cased; all words as one shingle where they are fewer).
    Two documents link if 100 |A & B| >= percent |A | B|. component_id is the smallest doc_id that can be reached,
    kept is doc_id = component_id. A null, empty or blank text has no shingles and links with nothing: its own
    doc_id. Rows that repeat a doc_id are kept or not each by its text. A null doc_id counts only where a component has
    no other; its kept is false unless the component_id is null too. Empty table: empty result.
    """
    made = checkpointed(signatures(in_small_batches(docs), k))
    rows = made.count()
    found_sets = made.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a class's number holds from here on, as the table is kept
    classes = checkpointed(found_sets.withColumn("node", F.monotonically_increasing_id()))
    bounds = classes.select("node", F.explode("bands").alias("band"))
    sketches = classes.select("node", "sketch")
    links, roots, wanted = None, None, percent / 100 - MARGIN

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs, found)
        pairs = sized(pairs, pairs.count())
        x = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("p")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("q")), "b")
        return x.select("a", "b", likeness(F.col("p"), F.col("q")).alias("like")).where(F.col("like") >= wanted)

    def full_sets(nodes: DataFrame) -> DataFrame:
        nodes = checkpointed(nodes, rows)
        wanted = checkpointed(classes.select("node", "rep", "digest").join(sized(nodes, nodes.count()), "node"), rows)
        return checkpointed(_full_sets(docs, wanted, wanted.count(), k))

    def confirm(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return _confirmed(pairs, full_sets(nodes), percent)

    def add(pairs: DataFrame) -> None:
        """Confirms pairs: for each class its likest one first, then what is still between components."""
        pairs = checkpointed(alike(pairs), found)
        best = pairs.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b"))
        for step in (lambda: best, lambda: _apart(pairs, roots)):
            new = checkpointed(step().select("a", "b"), found)
            if new.isEmpty():
                continue
            join(confirm(new))

    def join(new: DataFrame) -> None:
        nonlocal links, roots
        links = checkpointed(new if links is None else links.unionByName(new), found)
        roots = checkpointed(components(links), rows)
        roots = sized(roots, rows)

    heads = bounds.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bounds.join(heads, "band"), BANDS * rows)
    found = members.count()
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    top = members.where(F.col("n") > PIVOTS + 1).join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("x")).select("band", F.col("x.node").alias("pivot"))
    pivots = checkpointed(top.unionByName(members.where(F.col("n") <= PIVOTS + 1).select("band", F.col("node").alias("pivot"))), found)
    add(members.join(pivots, "band").where("node != pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
    left = _rooted(members.where(F.col("n") > PIVOTS + 1).select("band", "node"), roots)
    # a bucket whose members are one component has nothing left to say
    open_ = left.groupBy("band", "root").agg(F.lit(1).alias("one")).groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    left = checkpointed(left.join(open_.select("band"), "band").select("node").distinct(), rows)
    if not left.isEmpty():
        sets = full_sets(left)
        groups = components(_prefixes(sets, percent)).select("node", F.col("root").alias("group"))
        groups = checkpointed(_rooted(groups, roots), rows)
        join(_block_links(sets.join(sized(groups, rows), "node"), percent))
    root = _rooted(classes.select("node", "digest", "rep"), roots)
    least = root.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = root.select("digest", "root").join(least, "root").select("digest", "component_id")
    full = made.where("digest is not null").select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    out = full.unionByName(made.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """docs with one document of each group of near copies (linked as in near_duplicates), that with the smallest doc_id.

    Documents without words all stay. Rows that repeat a doc_id stay, once for each text, unless all of them go. Null
    doc_ids count as one doc_id. Empty table: empty result.
    """
    made = near_duplicates(docs, percent, k)
    by_id = checkpointed(made.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    gone = by_id.where("not kept").select(F.struct(F.col("doc_id").alias("i")).alias("_gone"))
    # a struct is never null, so null doc_ids meet by a plain equality
    own = F.struct(F.col("doc_id").cast("long").alias("i"))
    rest = docs.join(sized(gone, gone.count()), own == F.col("_gone"), "left_anti")
    twice = by_id.where("kept and rows > 1").select(F.struct(F.col("doc_id").alias("i")).alias("_twice"))
    if twice.isEmpty():
        return rest
    return rest.join(twice, own == F.col("_twice"), "left_anti").unionByName(rest.join(twice, own == F.col("_twice"), "left_semi").dropDuplicates(["doc_id", "text"]))


def _rooted(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col("node"))
    return df.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components."""
    if roots is None:
        return pairs
    a = _rooted(pairs.withColumn("node", F.col("a")), roots).withColumnRenamed("root", "_ra").drop("node")
    return _rooted(a.withColumn("node", F.col("b")), roots).where("_ra != root").select("a", "b")
