"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

A document longer than a sequence is cut into whole sequences, but for its first piece, so one piece a document at most
is left to be packed. These pieces are packed in rounds, each a few shuffles of (number, length) rows:

1. Gaps of open sequences are offered to the longest pieces that wait, those of above half the longest length, till all
   of them are placed; then to the next ones. A gap of several times their largest length is offered as several slots.
2. These pieces and the slots are range-sorted together by length. Each range is swept from short to long: a slot takes
   the longest waiting piece before it that no shorter slot has taken, so a piece gets its successor among the slots,
   and of several that want one slot the nearest in rank has it (brackets that close: each slot closes the last piece
   that is still open). What is left open in a range, and slots that found none in theirs, are counted; from these
   counts alone, two numbers a range, it follows which ranges' leftovers match, by rank.
3. Gaps are updated by what they took.

When no gap is left that could take one of these pieces, as many sequences are opened as a lower bound says that they
need in any packing (the larger of their total and Martello and Toth's bound, from counts by length).
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import PART_ROWS, checkpointed, free_name, in_small_batches, sized, small_batches

LENGTH = 2048
END = 0
#: The tokenizer (its file) and the same vocabulary as ranks, which is four times as fast.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces below this part of a sequence are packed all together.
SHORT = 16
#: (number, length) rows of one range.
RANGE_ROWS = 100_000


@lru_cache(2)
def tokenizer(path: str, ranks: str | None):
    """A function from a text to its ids, those that the tokenizer file gives without special tokens added.

    With ranks, the same vocabulary as byte-pair ranks is used for all texts but those that hold one of the file's added
    tokens, which the file tells in texts.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if not ranks:
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if any(a in text for a in added) else fast.encode_ordinary(text)


def pieces(docs: DataFrame, keep: list[str], length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """keep, piece, start, length, ids_crc32 (and ids): the pieces of each row's text, its ids followed by END.

    A null text is empty, so it has END alone. Pieces are numbered from 0; all but the first have the full length.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    table = ranks if ranks or vocabulary else public_tokenizers.path(RANKS)
    text = free_name(docs.select(*keep), "text")
    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "piece int", "start long", "length long", "ids_crc32 long", *(["ids binary"] if ids else [])])

    def cut(batches):
        encode = tokenizer(path, table)
        for b in batches:
            row, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for i, t in enumerate(b.column(text)):
                all_ids = np.array([*encode(t.as_py() or ""), END], "<u4")
                n, at = len(all_ids), 0
                while at < n:
                    end = at + ((n - at) % length or length)
                    part = all_ids[at:end].tobytes()
                    for k, v in zip(out, (out["piece"][-1] + 1 if at else 0, at, end - at, zlib.crc32(part), part if ids else None), strict=True):
                        out[k].append(v)
                    row.append(i)
                    at = end
            place = pa.array(row, pa.int64())
            kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(place) for c in keep), *(pa.array(out[k], t) for k, t in kinds)], [*keep, *(k for k, _ in kinds)])

    return in_small_batches(docs.select(*keep, F.col("text").alias(text))).mapInArrow(cut, schema)


def least_sequences(counts: dict[int, int], length: int) -> int:
    """A number of sequences that any packing of pieces needs: counts of pieces by length."""
    n = np.zeros(length + 1, np.int64)
    for size, k in counts.items():
        n[size] = k
    size = np.arange(length + 1)
    many, total = np.r_[0, n.cumsum()], np.r_[0, (n * size).cumsum()]  # of those below a length
    best, half = -(-int(total[-1]) // length), length // 2
    for k in range(1, half + 1):
        # pieces above length - k stand alone, those above half each have a sequence, those from k on must fit beside
        alone, big = int(many[-1] - many[length - k + 1]), int(many[length - k + 1] - many[half + 1])
        room = big * length - int(total[length - k + 1] - total[half + 1])
        best = max(best, alone + big + max(0, -(-(int(total[half + 1] - total[k]) - room) // length)))
    return best


def _swept(parts):
    """Sorted rows of one range -> matched rows (seq set, rank null) and what is left (part, kind, rank)."""

    def run(batches):
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not len(whole):
            return
        number, size, slot, part = (whole.column(c).to_numpy() for c in ("number", "size", "slot", "part"))
        order = np.lexsort((slot, size))  # a piece before the slots of its own length
        number, size, slot = number[order], size[order], slot[order]
        piece, closer = bracket(slot)
        left = np.ones(len(slot), bool)
        left[piece] = left[closer] = False
        yield pa.RecordBatch.from_pydict({"number": number[piece], "size": size[piece], "seq": number[closer], "part": pa.nulls(len(piece), pa.int32()), "slot": pa.nulls(len(piece), pa.int32()), "rank": pa.nulls(len(piece), pa.int64())})
        at = np.flatnonzero(left)
        kind = slot[at]
        # open pieces from the longest on, slots from the shortest on
        pieces_left, slots_left = at[kind == 0][::-1], at[kind == 1]
        at = np.r_[pieces_left, slots_left]
        rank = np.r_[np.arange(len(pieces_left)), np.arange(len(slots_left))]
        yield pa.RecordBatch.from_pydict({"number": number[at], "size": size[at], "seq": pa.nulls(len(at), pa.int64()), "part": np.full(len(at), part[0], np.int32), "slot": slot[at].astype(np.int32), "rank": rank})

    return parts.mapInArrow(run, "number long, size long, seq long, part int, slot int, rank long")


def bracket(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pieces (0) and of the slots (1) that close them, as brackets do."""
    height = np.cumsum(1 - 2 * slot.astype(np.int64))
    height -= np.minimum(np.minimum.accumulate(height), 0)  # a slot with nothing open closes nothing
    depth = height + slot  # of a piece after it opens, of a slot before it closes
    before = np.r_[0, height[:-1]]
    usable = np.flatnonzero((slot == 0) | (before > 0))
    order = usable[np.argsort(depth[usable], kind="stable")]
    closes = np.flatnonzero((slot[order[1:]] == 1) & (slot[order[:-1]] == 0) & (depth[order[1:]] == depth[order[:-1]]))
    return order[closes], order[closes + 1]


def meetings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(piece part, first rank, slot part, first rank, how many) from (part, pieces left, slots left), parts in order.

    A stack of ranges: the slots of a range close the open pieces of the ranges before, the nearest range first.
    """
    opened, out = [], []
    for part, pieces_left, slots_left in sorted(left):
        at = 0
        while at < slots_left and opened:
            p, first, n = opened.pop()
            k = min(n, slots_left - at)
            out.append((p, first, part, at, k))
            at += k
            if k < n:
                opened.append((p, first + k, n - k))
        if pieces_left:
            opened.append((part, 0, pieces_left))
    return out


def _matched(waiting: DataFrame, slots: DataFrame, rows: int) -> DataFrame:
    """(number, size, seq) of waiting (number, size) after a round with slots (number, size); seq null where none was found."""
    spark = waiting.sparkSession
    both = waiting.withColumn("slot", F.lit(0)).unionByName(slots.withColumn("slot", F.lit(1)))
    # equal lengths are spread by hash, pieces and slots alike
    if rows <= RANGE_ROWS:  # one range, which has no other to match with
        return _swept(both.repartition(1).withColumn("part", F.lit(0))).where("slot is null or slot = 0").select("number", "size", "seq")
    ranges = both.repartitionByRange(-(-rows // RANGE_ROWS), "size", F.xxhash64("number", "slot")).withColumn("part", F.spark_partition_id())
    swept = checkpointed(_swept(ranges), rows)
    here = swept.where(F.col("seq").isNotNull()).select("number", "size", "seq")
    rest = swept.where(F.col("seq").isNull())
    left = rest.groupBy("part").agg(F.sum(1 - F.col("slot")).alias("p"), F.sum("slot").alias("s")).collect()  # two numbers a range
    found = meetings([(r.part, r.p, r.s) for r in left])
    mine = rest.where("slot = 0")
    if not found:
        return here.unionByName(mine.select("number", "size", "seq"))
    met = F.broadcast(spark.createDataFrame([(i, *m) for i, m in enumerate(found)], "meeting long, p int, pf long, s int, sf long, n long"))
    rank = F.col("rank")
    mine = mine.drop("seq").join(met, (F.col("part") == F.col("p")) & (rank >= F.col("pf")) & (rank < F.col("pf") + F.col("n")), "left")
    theirs = rest.where("slot = 1").drop("seq").join(met, (F.col("part") == F.col("s")) & (rank >= F.col("sf")) & (rank < F.col("sf") + F.col("n")))
    mine = mine.select("meeting", (rank - F.col("pf")).alias("nth"), "number", "size")
    theirs = theirs.select("meeting", (rank - F.col("sf")).alias("nth"), F.col("number").alias("seq"))
    return here.unionByName(mine.join(theirs, ["meeting", "nth"], "left").select("number", "size", "seq"))


def packed(waiting: DataFrame, length: int) -> DataFrame:
    """(number, size, seq) of all waiting (number, size): numbers are unique, sizes from 1 to length; seq from 0.

    The longer half of lengths goes first, then the longer half of what is below, and so on down to SHORT. Sizes are counted on the
    driver, in `length` numbers at most.
    """
    spark = waiting.sparkSession
    gaps = spark.createDataFrame([], "seq long, gap long")
    taken, opened, above = None, 0, length + 1
    all_counts = {r["size"]: r["count"] for r in waiting.groupBy("size").count().collect()}
    while below := [size for size in all_counts if size < above]:
        least = min(max(below), (above + 1) // 2) if above > length // SHORT else 1
        band = waiting.where((F.col("size") >= least) & (F.col("size") < above))
        counts = {size: all_counts[size] for size in below if size >= least}
        while counts:
            most, n = max(counts), sum(counts.values())
            usable = F.col("gap") >= min(counts)
            if not (count := gaps.where(usable).count()):
                k = least_sequences(counts, length)
                gaps = gaps.unionByName(spark.range(opened, opened + k).select(F.col("id").alias("seq"), F.lit(length).cast("long").alias("gap")))
                opened, count = opened + k, k
            # a gap has so many slots that all pieces find one, but no more than can each take the longest piece
            several = max(1, -(-2 * n // count))
            parts = F.least(F.lit(several), F.greatest(F.lit(1), F.expr(f"gap div {most}"))).cast("int")
            slots = gaps.where(usable).withColumn("parts", parts).select(F.col("seq").alias("number"), "gap", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("i"))
            slots = slots.select("number", F.when(F.col("i") < F.col("parts"), F.lit(most)).otherwise(F.col("gap") - (F.col("parts") - 1) * most).cast("long").alias("size"))
            tried = checkpointed(_matched(band, slots, 3 * n + count), n)
            new, band = tried.where(F.col("seq").isNotNull()), tried.where(F.col("seq").isNull()).select("number", "size")
            used = new.groupBy("seq").agg(F.sum("size").alias("used"))
            gaps = gaps.join(sized(used, n), "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            gaps = checkpointed(gaps.where("gap > 0").coalesce(-(-opened // PART_ROWS)))
            taken = new if taken is None else taken.unionByName(new)
            counts = {r["size"]: r["count"] for r in band.groupBy("size").count().collect()}
        above = least
    return spark.createDataFrame([], "number long, size long, seq long") if taken is None else taken


def pack(docs: DataFrame, keep: list[str], length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """keep, piece, start, length, ids_crc32, sequence_id, offset: each piece's place in a sequence of at most `length`.

    Places in a sequence have no gaps. A null or empty text has one piece of one id. Rows that repeat, in their id or
    wholly, are documents of their own. An empty table has no pieces. Columns of keep must have other names than the
    results; all other columns are not used. A very long text is one row in a task, its ids are cut there.
    """
    made = {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    if clash := made & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    number, seq = free_name(docs.select(*keep), "_number"), free_name(docs.select(*keep), "_seq")
    cut = checkpointed(pieces(docs, keep, length, vocabulary, ranks).withColumn(number, F.monotonically_increasing_id()))
    parts = cut.where(F.col("length") < length).select(F.col(number).alias("number"), F.col("length").alias("size"))
    with small_batches(docs.sparkSession, 64 << 20):
        placed = packed(checkpointed(parts), length).select(F.col("number").alias(number), F.col("seq").alias(seq))
    # full pieces are sequences of their own, with odd numbers
    where = F.coalesce(2 * F.col(seq), 2 * F.col(number) + 1)
    before = Window.partitionBy("sequence_id").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.join(placed, number, "left").withColumn("sequence_id", where).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return whole.select(*keep, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
