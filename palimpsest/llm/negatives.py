"""Hard-negative mining by distributed radix selection.

Anchors, packed in blocks, meet all rows, packed in blocks, and a pair of blocks is one product of matrices; no pair of
rows is ever a row of a table. What an anchor looks for is a window: scores from one whole number to another, a label
that is or isn't its own, and how many of the first rows are wanted. All windows of all anchors are looked into at once:

* A pass counts, in each task, how many rows of a window lie in each of 256 ranges of scores. A task tells the counts of
  its ranges from the highest score on until they make up the wanted number, as the range that holds the last wanted row
  of all lies no deeper. The counts are summed by window and range, and the range of the last wanted row becomes the
  window's next one, 8 bits narrower.
* Where one score alone is left and still too many rows have it, the next digits are those of the row's place in the
  order of ids, so equal vectors in any number are told apart without being gathered.
* A window is ready as soon as no more than GATHER times the wanted rows stand at or above its range. One pass more
  gathers these rows of all windows, and only they are ranked.

The anchors' first rows of their own label are found in this way, then the windows that these positives open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpointed, small_batches

#: Rows of a block of anchors and of a block of rows; windows that one vectorised step looks into.
ANCHORS, ROWS, STEP = 512, 2048, 256
#: Rows of a partition of anchors and of rows; a task meets one of each.
ANCHOR_PART, ROW_PART = 8192, 65_536
BITS = 8
GATHER = 4
_LAST = 2**63 - 1
_FOUND = "win long, score long, place long, id long"
_COUNTED = "win long, bucket int, n long"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, data): size rows each as bytes; block is the place of the first."""

    def pack(batches):
        held: list[pa.RecordBatch] = []
        for b in [*batches, None]:
            if b is not None:
                held.append(b)
            while held and (sum(map(len, held)) >= size or b is None and sum(map(len, held))):
                whole = pa.Table.from_batches(held).combine_chunks()
                part, rest = whole.slice(0, size), whole.slice(size)
                held = rest.to_batches()
                x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                ids = part.column("id").combine_chunks()
                own = np.stack([part.column("place").to_numpy(), ids.fill_null(0).to_numpy(), np.asarray(ids.is_null(), np.int64), part.column("label").to_numpy()]).astype("<i8")
                x = x.astype("<f4") if np.abs(x).max(initial=0) < 2**24 else x.astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own[0, :1]), pa.array([len(part)], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.dtype.str])], ["block", "rows", "own", "x", "kind"])

    return rows.mapInArrow(pack, "block long, rows int, own binary, x binary, kind string")


def _vectors(data: bytes, rows: int, kind: str, exact: bool) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1).astype(np.float64 if exact else np.int64)


def _pairs(batches, exact: bool):
    """(block of anchors, its windows, own columns of rows, scores of all its anchors) of each pair of blocks."""
    block, windows = None, {}
    for b in batches:
        for r in b.to_pylist():
            if r["block"] != block:
                block, windows = r["block"], {k: np.frombuffer(r[k], "<i8") for k in _WINDOW}
            a, x = (_vectors(r[p + "x"], r[p + "rows"], r[p + "kind"], exact) for p in ("", "r_"))
            yield block, windows, np.frombuffer(r["r_own"], "<i8").reshape(4, -1), (a @ x.T).astype(np.int64)


#: A window: its number, its anchor's row in the block, place and label, whether the label is to be the same, how many
#: more rows are wanted, the range of scores, whether its places are looked at and their range, bits below the digit.
_WINDOW = ("win", "slot", "at", "label", "same", "need", "low", "high", "by_place", "first", "last", "shift")


def _count(exact: bool):
    def run(batches):
        block, told, windows = None, None, None
        for at, w, own, scores in _pairs(batches, exact):
            if at != block:
                if told is not None:
                    yield _ranges(windows, told)
                block, windows, told = at, w, np.zeros((len(w["win"]), 1 << BITS), np.int64)
                deepest = np.full(len(w["win"]), (1 << BITS) - 1)
            place, label = own[0], own[3]
            for i in range(0, len(w["win"]), STEP):
                p = {k: v[i : i + STEP, None] for k, v in w.items()}
                s = scores[p["slot"][:, 0]]
                fits = (s >= p["low"]) & (s <= p["high"]) & ((label == p["label"]) == (p["same"] == 1)) & (place != p["at"])
                if p["by_place"].any():
                    fits &= (p["by_place"] == 0) | (place >= p["first"]) & (place <= p["last"])
                x, y = np.nonzero(fits)
                flat = {k: v[:, 0][x] for k, v in p.items()}
                digit = np.where(flat["by_place"] == 1, place[y] - flat["first"], flat["high"] - s[x, y]) >> flat["shift"]
                x, digit = x[keep := digit <= deepest[i : i + STEP][x]], digit[keep]
                if len(x):
                    told[i : i + STEP] += np.bincount((x << BITS) + digit, minlength=len(s) << BITS).reshape(-1, 1 << BITS)
                    enough = told[i : i + STEP].cumsum(1) >= p["need"]
                    deepest[i : i + STEP] = np.where(enough.any(1), enough.argmax(1), (1 << BITS) - 1)
        if told is not None:
            yield _ranges(windows, told)

    return run


def _ranges(windows: dict[str, np.ndarray], told: np.ndarray) -> pa.RecordBatch:
    """Counts of each window's ranges down to the one that makes up what is wanted."""
    before = told.cumsum(1) - told
    x, y = np.nonzero((told > 0) & (before < windows["need"][:, None]))
    return pa.RecordBatch.from_pydict({"win": windows["win"][x], "bucket": y.astype(np.int32), "n": told[x, y]})


def _gather(exact: bool):
    def run(batches):
        for _, w, own, scores in _pairs(batches, exact):
            place, ids, none, label = own
            for i in range(0, len(w["win"]), STEP):
                p = {k: v[i : i + STEP, None] for k, v in w.items()}
                s = scores[p["slot"][:, 0]]
                x, y = np.nonzero((s <= p["high"]) & ((s > p["low"]) | (s == p["low"]) & (place <= p["last"])) & ((label == p["label"]) == (p["same"] == 1)) & (place != p["at"]))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(p["win"][:, 0][x]), pa.array(s[x, y]), pa.array(place[y]), pa.array(ids[y], mask=none[y] == 1)], ["win", "score", "place", "id"])

    return run


def _met(windows: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs of a block of anchors, with its windows, and a block of rows."""
    arrays = windows.groupBy("block").agg(F.collect_list(F.struct(*(F.col(k).cast("long").alias(k) for k in _WINDOW))).alias("w"))

    def packed(batches):
        for b in batches:
            w = b.column("w")
            made = [[np.asarray(each.values.field(k), np.int64).tobytes() for each in w] for k in _WINDOW]
            yield pa.RecordBatch.from_arrays([b.column("block"), *(pa.array(m, pa.binary()) for m in made)], ["block", *_WINDOW])

    asked = arrays.mapInArrow(packed, ", ".join(["block long", *(f"{k} binary" for k in _WINDOW)])).join(anchors.drop("own"), "block")
    parts = rows.select(*(F.col(c).alias(f"r_{c}") for c in ("rows", "own", "x", "kind")))
    # a Cartesian product: an anchor block stays while all row blocks of the other partition pass
    return asked.coalesce(_parts(anchors)).hint("shuffle_replicate_nl").crossJoin(parts)


def _parts(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def _selected(windows: DataFrame, anchors: DataFrame, rows: DataFrame, exact: bool) -> DataFrame:
    """(win, score, place, id, rank): the first rows of each window. windows: win, block, slot, at, label, same, want, low, high."""
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("high") - F.col("low"))) - BITS)
    fresh = windows.withColumns({"top": F.col("high"), "need": F.col("want"), "by_place": F.lit(0), "first": F.lit(0).cast("long"), "last": F.lit(_LAST), "shift": shift, "open": F.lit(True)})
    state = checkpointed(fresh.where("low <= high"))
    limit = rows.agg(F.max("end")).first()[0] or 0
    while not (opened := state.where("open")).isEmpty():
        counted = _met(opened, anchors, rows).mapInArrow(_count(exact), _COUNTED).groupBy("win", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("win").orderBy("bucket")
        run = counted.withColumn("upto", F.sum("n").over(order)).join(opened.select("win", F.col("need").alias("_need")), "win")
        hit = run.where(F.col("upto") >= F.col("_need")).groupBy("win").agg(F.min(F.struct("bucket", "upto", "n")).alias("hit"))
        state = checkpointed(_narrowed(state.join(hit, "win", "left"), limit).drop("hit"))
    # the gathering pass takes scores from the window's own top down
    ready = state.withColumn("high", F.col("top"))
    found = _met(ready, anchors, rows).mapInArrow(_gather(exact), _FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "place")))
    return checkpointed(ranked.join(windows.select("win", "want"), "win").where(F.col("rank") <= F.col("want")).drop("want"))


def _narrowed(state: DataFrame, limit: int) -> DataFrame:
    """Each open window with the range of its last wanted row; it is closed where few rows are left or all are wanted."""
    hit, shift, by = F.col("hit"), F.col("shift"), F.col("by_place") == 1
    none = F.col("open") & hit.isNull()  # fewer rows than are wanted: all of them
    few = (F.col("want") - F.col("need") + hit["upto"]) <= GATHER * F.col("want")
    one = shift == 0
    start, width = F.expr("shiftleft(cast(hit.bucket as bigint), shift)"), F.expr("shiftleft(1L, shift)")
    high = F.col("high") - start
    low = F.greatest(F.col("low"), high - width + 1)
    first = F.col("first") + start
    last = F.least(F.col("last"), first + width - 1)
    place_bits = max(0, int(limit).bit_length() - BITS)
    to_place = ~by & one & ~few
    live = F.col("open") & ~none

    def new(value: Column, old: str) -> Column:
        return F.when(live, value).otherwise(F.col(old))

    return state.withColumns(
        {
            "low": new(F.when(by, F.col("low")).otherwise(low), "low"),
            "high": new(F.when(by, F.col("high")).otherwise(high), "high"),
            "need": new(F.col("need") - (hit["upto"] - hit["n"]), "need"),
            "first": new(F.when(by, first).otherwise(F.col("first")), "first"),
            "last": new(F.when(by, last).when(to_place, F.lit(limit)).otherwise(F.col("last")), "last"),
            "shift": new(F.when(to_place, F.lit(place_bits)).otherwise(F.greatest(F.lit(0), shift - BITS)), "shift"),
            "by_place": new(F.when(to_place, F.lit(1)).otherwise(F.col("by_place")), "by_place"),
            "open": live & ~few & ~(by & one),
        }
    )


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    df has id (long), label (of a whole-number type) and x (array<long>); anchor is a condition on them. A row's score is
    its inner product with the anchor, higher ones come first, then smaller ids. Positives of an anchor are its first
    `positives` other rows of its label; for each, the first `negatives` rows of other labels are given whose score is
    from low to high hundredths of the positive's. A window without such a row has no row.

    Rows with a null label, a null vector or a null entry take no part, nor do vectors whose number of entries isn't the
    one that most have. A null id is the last of equal scores and may be an anchor, a positive or a negative like any
    other (its column is null then). Rows that repeat an id, or all columns, are rows of their own; only the anchor's own
    row is no row of its own. Empty tables and tables without anchors give no rows. Other columns are not used. An
    inner product may come near 2^60; a table whose largest ones can pass that is refused.
    """
    rows = df.select("id", F.col("label").cast("long").alias("label"), "x").where(F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda c: c.isNotNull()), F.lit(False)))
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    session = df.sparkSession
    if not top:
        return session.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if top.most >= 2**60:
        raise ValueError("inner products of these vectors can pass the range of longs")
    exact = top.most < 2**52  # then doubles hold every partial sum
    with small_batches(session):
        order = [F.col("id").asc_nulls_last(), F.col("_row")]
        placed = rows.where(F.size("x") == top.d).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
        placed = checkpointed(placed.drop("_row").withColumn("place", F.monotonically_increasing_id()))
        cores = session.sparkContext.defaultParallelism
        asking = placed.where(anchor)
        row_blocks = _blocks(placed.coalesce(max(cores, -(-top.n // ROW_PART))), ROWS)
        row_blocks = checkpointed(row_blocks.withColumn("end", F.lit(placed.agg(F.max("place")).first()[0])))
        anchors = checkpointed(_blocks(asking.coalesce(-(-max(1, asking.count()) // ANCHOR_PART)), ANCHORS))

        def slots(batches):
            for b in batches:
                for r in b.to_pylist():
                    own = np.frombuffer(r["own"], "<i8").reshape(4, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(r["rows"], r["block"])), pa.array(np.arange(r["rows"])), pa.array(own[0]), pa.array(own[1], mask=own[2] == 1), pa.array(own[3])], ["block", "slot", "at", "anchor_id", "label"])

        each = checkpointed(anchors.mapInArrow(slots, "block long, slot long, at long, anchor_id long, label long"))
        bound = int(top.most) + 1
        windows = each.select(F.col("at").alias("win"), "block", "slot", "at", "label", F.lit(1).alias("same"), F.lit(positives).cast("long").alias("want"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"))
        near = _selected(windows, anchors, row_blocks, exact).select(F.col("win").alias("at"), F.col("rank").alias("_p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        opened = checkpointed(near.join(each, "at").withColumn("win", F.col("at") * positives + F.col("_p") - 1))
        least = F.expr(f"-((-{low} * positive_score) - pmod(-{low} * positive_score, 100)) div 100")
        most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
        windows = opened.select("win", "block", "slot", "at", "label", F.lit(0).alias("same"), F.lit(negatives).cast("long").alias("want"), least.alias("low"), most.alias("high"))
        found = _selected(windows, anchors, row_blocks, exact)
    return found.join(opened, "win").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
