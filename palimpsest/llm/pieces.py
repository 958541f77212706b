"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for each vocabulary piece that matches, and for a character without a piece one edge
of its byte pieces. Backward sums give each edge its share of its node, so that a path drawn edge by edge is drawn
from the model. A text's best segmentation has the root's Gumbel value; a sibling edge next to a drawn path is a
subtree whose best value is a Gumbel of its mass, cut off at the path's. An A-star search takes the subtree with the
highest value, draws the path on below it, and adds that path's siblings: its k first paths are a sample of k distinct
segmentations without replacement, in order. With the value of the best subtree left over as threshold, each
segmentation has its inclusion score log(1 - exp(-exp(log p - threshold))).

A space always starts a lattice unit, as no piece has one after another character. A long unit is cut only where no
piece of the vocabulary crosses, which every path passes through; its sums are kept in scale, so a unit may be as long
as its text. Units are looked up once for a few MB of texts, all steps are numpy over all their units. Random numbers
come from a hash of seed, row key, path and place, so they don't depend on the batch.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, in_small_batches, steps
from palimpsest.llm.shingles import scramble

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 1.0
SEED = 3
#: Units of more characters are cut where no piece crosses, and their sums kept in scale.
LONG = 64
SPACE, LITERAL = 0x2581, 0x110000  # a space in pieces; that very character in a text, which has only byte pieces
#: Log probability of a character without a piece; nats that one character adds, against underflow.
FALLBACK, LIFT = -12.0, 4.0
#: Subtrees of a smaller share of all segmentations (log) are looked at only where a text has no larger ones.
LEAST = -40.0
_UNITS = re.compile(" *[^ ]+| +")
#: Characters of text that one search works on.
STEP = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Model:
    """A vocabulary as a trie in a hash table, with log probabilities by Zipf's law from the pieces' ranks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes: list[bytes] = [b""] * n
        usable = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                if "▁" not in piece.lstrip("▁"):
                    usable.append((i, piece))
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        ranks = np.array([-sp.get_score(i) for i, _ in usable])
        p = 1 / (ranks - ranks.min() + 10)
        self.log_p = np.zeros(n)
        self.log_p[[i for i, _ in usable]] = np.log(p / p.sum())
        trie: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, piece in usable:
            node = 0
            for c in map(ord, piece):
                if (node, c) not in trie:
                    trie[node, c] = len(ends)
                    ends.append(-1)
                node = trie[node, c]
            ends[node] = i
        self.ends = np.array(ends)
        self._bits = max(8, (len(trie) * 8).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._next = np.zeros(1 << self._bits, np.int64)
        keys = np.array([node << 21 | c for node, c in trie], np.int64)
        for key, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), trie.values(), strict=True):
            while self._keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self._bits) - 1)
            self._keys[slot], self._next[slot] = key, to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _A) >> np.uint64(64 - self._bits)).astype(np.int64)

    def follow(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The trie's node after each node by each code point; -1 if there is none."""
        keys = nodes << 21 | points
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._next[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


    def pieces_at(self, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces that match from each place on, up to the unit's end `last`; by length."""
        place = np.arange(len(points))
        pos, node, length = place, np.zeros(len(points), np.int64), 0
        src, ln, piece = [], [], []
        while len(pos):
            inside = pos + length < last[pos]
            pos, node = pos[inside], node[inside]
            node = self.follow(node, points[pos + length])
            on = node >= 0
            pos, node = pos[on], node[on]
            length += 1
            ends = self.ends[node]
            whole = ends >= 0
            src.append(pos[whole])
            ln.append(np.full(int(whole.sum()), length))
            piece.append(ends[whole])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, ln, piece))

    def cut(self, unit: str) -> list[str]:
        """A long unit in parts, cut where no piece that matches crosses."""
        points = code_points([unit])
        src, ln, _ = self.pieces_at(points, np.full(len(points), len(points)))
        reach = np.arange(1, len(points) + 1)
        np.maximum.at(reach, src, src + ln)
        safe = np.flatnonzero(np.maximum.accumulate(reach)[:-1] <= np.arange(1, len(points))) + 1
        return [unit[a:b] for a, b in zip([0, *safe.tolist()], [*safe.tolist(), len(unit)], strict=True)]


def code_points(units: list[str]) -> np.ndarray:
    """Code points of all units in a row, with spaces as pieces write them."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[points == SPACE] = LITERAL
    points[points == 32] = SPACE
    return points


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


@dataclass
class Lattice:
    """Edges of all units, by node and falling length; node of unit u's start: first[u]."""

    first: np.ndarray
    start: np.ndarray  # of a node's edges
    count: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # below 0: -1 - code point, as bytes
    log_share: np.ndarray
    until: np.ndarray  # cumulated shares of a node's edges; the last is infinite


def lattice(units: list[str], m: Model, alpha: float) -> Lattice:
    points = code_points(units)
    size = np.array([len(u) for u in units], np.int64)
    end = np.cumsum(size)
    last = np.repeat(end, size)
    src, ln, piece = m.pieces_at(points, last)
    alone = np.ones(len(points), bool)
    alone[src[ln == 1]] = False
    alone = np.flatnonzero(alone)
    src, ln, piece = np.r_[alone, src], np.r_[np.ones(len(alone), np.int64), ln], np.r_[-1 - points[alone], piece]
    order = np.lexsort((-ln, src))  # by node, the longest pieces first
    src, ln, piece = src[order], ln[order], piece[order]
    unit = np.repeat(np.arange(len(units)), size)
    left = last[src] - src  # characters to the unit's end
    a = src + unit[src]  # a unit of n characters has n + 1 nodes
    b = a + ln
    weight = (np.exp(alpha * np.r_[m.log_p, FALLBACK])[np.where(piece < 0, len(m.log_p), piece)]) * np.exp(LIFT * np.arange(int(ln.max(initial=0)) + 1))[ln]
    mass = np.zeros(len(points) + len(units))
    mass[end + np.arange(len(units))] = 1
    most = int(left.max(initial=0))
    scale = np.zeros(len(mass)) if most > LONG else None  # logarithms; a node's mass is mass * exp(scale)
    order = np.argsort(left.astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
    cut = np.searchsorted(left[order], np.arange(1, most + 2))
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        e = order[x:y]
        if len(e):
            at = a[e]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            if scale is None:
                mass[at[starts]] = np.add.reduceat(weight[e] * mass[b[e]], starts)
            else:  # in the scale of the next node, which is the unit's next character
                total = np.add.reduceat(weight[e] * mass[b[e]] * np.exp(scale[b[e]] - scale[at + 1]), starts)
                far = (total < 1e-60) | (total > 1e60)
                mass[at[starts]] = np.where(far, 1.0, total)
                scale[at[starts]] = scale[at[starts] + 1] + np.where(far, np.log(total), 0.0)
    share = weight * mass[b] / mass[a]
    if scale is not None:
        share *= np.exp(scale[b] - scale[a])
    count = np.bincount(a, minlength=len(mass))
    start = np.cumsum(count) - count
    total = np.cumsum(share)
    until = total - (total[start[a]] - share[start[a]])
    until[(start + count - 1)[count > 0]] = np.inf
    return Lattice(np.r_[0, (end + np.arange(1, len(units) + 1))[:-1]], start, count, b, piece, np.log(share), until)


@dataclass
class Path:
    """Edges of one segmentation of each text, by unit and place in the unit."""

    unit: np.ndarray
    turn: np.ndarray
    edge: np.ndarray
    node: np.ndarray
    new: np.ndarray  # drawn for this path, not taken from the one it branches off
    before: np.ndarray  # log p of what comes before in the text
    log_p: np.ndarray  # by text


class Search:
    """The A-star search over a few texts at once."""

    def __init__(self, texts: list[str], keys: np.ndarray, m: Model, k: int, alpha: float, seed: int):
        known: dict[str, int] = {}
        ids, sizes = [], []
        for t in texts:
            found = _UNITS.findall(" " + t)
            if any(len(u) > LONG for u in found):
                found = [p for u in found for p in (m.cut(u) if len(u) > LONG else [u])]
            ids += [known.setdefault(u, len(known)) for u in found]
            sizes.append(len(found))
        self.lat, self.m, self.texts = lattice(list(known), m, alpha), m, len(texts)
        self.kind = np.array(ids, np.int64)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.begin = np.cumsum(sizes) - np.array(sizes, np.int64)
        self.number = np.arange(len(ids)) - self.begin[self.text]
        self.key = scramble(keys ^ scramble(np.full(len(texts), seed, np.uint64)))
        units = np.arange(len(ids))
        self.top = self._gumbel(self._random(self.key, np.uint64(0)))
        zeros = np.zeros(len(ids), np.int64)
        self.paths = [self._finish(*self._draw(units, self.lat.first[self.kind], zeros, 0), None, None)]
        self.values = [self.top]
        self.open = [self._siblings(0, self.top, np.ones(len(texts), bool))]
        self.has = [np.ones(len(texts), bool)]
        for p in range(1, k):
            self._next(p)
        best = np.full(len(texts), -np.inf)
        for c in self.open:
            np.maximum.at(best, c["text"], c["value"])
        self.threshold = best

    @staticmethod
    def _random(key: np.ndarray, at) -> np.ndarray:
        return ((scramble(key + at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    @staticmethod
    def _gumbel(u: np.ndarray) -> np.ndarray:
        return -np.log(-np.log(u))

    def _at(self, unit: np.ndarray, turn: np.ndarray, path: int, k) -> np.ndarray:
        """Number of a random number: by place in the text, path and kind of draw."""
        return self.number[unit].astype(np.uint64) * _A + turn.astype(np.uint64) * _B + np.uint64((path + 1) * 0x5851F42D4C957F2D % (1 << 64)) + np.asarray(k).astype(np.uint64) * _C

    def _draw(self, unit: np.ndarray, node: np.ndarray, turn: np.ndarray, path: int):
        """Edges from each unit's node to its end."""
        lat, out = self.lat, []
        while True:
            on = lat.count[node] > 0
            if not on.all():
                unit, node, turn = unit[on], node[on], turn[on]
            if not len(unit):
                break
            edge = lat.start[node].copy()
            more = np.flatnonzero(lat.count[node] > 1)
            u = self._random(self.key[self.text[unit[more]]], self._at(unit[more], turn[more], path, 0))
            while len(more):
                past = u > lat.until[edge[more]]
                more, u = more[past], u[past]
                edge[more] += 1
            out.append((unit, turn, edge, node))
            node, turn = lat.to[edge], turn + 1
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _finish(self, unit, turn, edge, node, old: Path | None, keep: np.ndarray | None) -> Path:
        """The drawn edges, after those kept of an older path, in order."""
        new = np.ones(len(unit), bool)
        if old is not None:
            unit, turn, edge, node = (np.r_[getattr(old, n)[keep], x] for n, x in (("unit", unit), ("turn", turn), ("edge", edge), ("node", node)))
            new = np.r_[np.zeros(int(keep.sum()), bool), new]
        count = np.bincount(unit, minlength=len(self.kind))
        order = np.empty(len(unit), np.int64)
        order[(np.cumsum(count) - count)[unit] + turn] = np.arange(len(unit))
        unit, turn, edge, node, new = unit[order], turn[order], edge[order], node[order], new[order]
        share = self.lat.log_share[edge]
        total = np.r_[0.0, np.cumsum(share)]
        bounds = np.searchsorted(self.text[unit], np.arange(self.texts + 1))
        return Path(unit, turn, edge, node, new, total[:-1] - total[bounds[:-1]][self.text[unit]], total[bounds[1:]] - total[bounds[:-1]])

    def _siblings(self, path: int, value: np.ndarray, has: np.ndarray) -> dict[str, np.ndarray]:
        """The edges next to the new ones of a path, each with the highest value below it."""
        p, lat = self.paths[path], self.lat
        free = p.new & (lat.count[p.node] > 1) & has[self.text[p.unit]]

        def beside(at: np.ndarray) -> tuple[np.ndarray, ...]:
            count = lat.count[p.node[at]]
            rep = np.repeat(at, count)
            k = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
            edge = lat.start[p.node[rep]] + k
            mass = p.before[rep] + lat.log_share[edge]
            on = edge != p.edge[rep]
            return rep[on], k[on], edge[on], mass[on]

        rep, k, edge, mass = beside(np.flatnonzero(free & (p.before >= LEAST)))
        large = mass >= LEAST
        rep, k, edge, mass = rep[large], k[large], edge[large], mass[large]
        few = has.copy()
        few[self.text[p.unit[rep]]] = False
        more = np.flatnonzero(free & few[self.text[p.unit]])
        if len(more):
            rep, k, edge, mass = (np.r_[x, y] for x, y in zip((rep, k, edge, mass), beside(more), strict=True))
        text = self.text[p.unit[rep]]
        u = self._random(self.key[text], self._at(p.unit[rep], p.turn[rep], path, k + 1))
        top = mass - np.log(np.exp(mass - value[text]) - np.log(u))
        return {"text": text, "value": top, "unit": p.unit[rep], "turn": p.turn[rep], "edge": edge, "node": p.node[rep], "path": np.full(len(rep), path)}

    def _next(self, number: int) -> None:
        """Takes each text's best open subtree and draws its path."""
        every = {n: np.concatenate([c[n] for c in self.open]) for n in self.open[0]}
        order = np.lexsort((-every["value"], every["text"]))
        first = order[np.r_[True, np.diff(every["text"][order]) != 0]] if len(order) else order
        left = np.ones(len(order), bool)
        left[first] = False
        take = {n: x[first] for n, x in every.items()}
        has = np.zeros(self.texts, bool)
        has[take["text"]] = True
        value = np.full(self.texts, -np.inf)
        value[take["text"]] = take["value"]
        # what stands before the branch comes from the path that it leaves; all paths' edges in one table
        unit_at, turn_at, of = (np.full(self.texts, x, np.int64) for x in (1 << 62, 0, 0))
        unit_at[take["text"]], turn_at[take["text"]], of[take["text"]] = take["unit"], take["turn"], take["path"]
        parts = []
        for i, p in enumerate(self.paths):
            text = self.text[p.unit]
            mine = (of[text] == i) & has[text]
            parts.append((p, mine & ((p.unit < unit_at[text]) | ((p.unit == unit_at[text]) & (p.turn < turn_at[text])))))
        old = Path(*(np.concatenate([getattr(p, n)[on] for p, on in parts]) for n in ("unit", "turn", "edge", "node", "new", "before")), np.zeros(0))
        after = np.flatnonzero(has[self.text] & (np.arange(len(self.kind)) > unit_at[self.text]))
        units = np.r_[take["unit"], after]
        nodes = np.r_[self.lat.to[take["edge"]], self.lat.first[self.kind[after]]]
        turns = np.r_[take["turn"] + 1, np.zeros(len(after), np.int64)]
        drawn = self._draw(units, nodes, turns, number)
        drawn = tuple(np.r_[take[n], x] for n, x in zip(("unit", "turn", "edge", "node"), drawn, strict=True))
        self.paths.append(self._finish(*drawn, old, np.ones(len(old.unit), bool)))
        branch = self.paths[-1]
        # the branching node's other edges are open already
        at = branch.new & (branch.unit == unit_at[self.text[branch.unit]]) & (branch.turn == turn_at[self.text[branch.unit]])
        branch.new = branch.new & ~at
        self.open = [{n: x[left] for n, x in every.items()}, self._siblings(number, value, has)]
        self.values.append(value)
        self.has.append(has)

    def ids(self, path: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, and where each text's end."""
        p = self.paths[path]
        piece, text = self.lat.piece[p.edge], self.text[p.unit]
        if (piece < 0).any():
            raw = {c: "".join(chr(0x2581 if c == LITERAL else c)).encode("utf-8", "surrogatepass") for c in np.unique(-1 - piece[piece < 0]).tolist()}
            many = np.ones(len(piece), np.int64)
            low = np.flatnonzero(piece < 0)
            many[low] = [len(raw[c]) for c in (-1 - piece[low]).tolist()]
            starts = np.cumsum(many) - many
            text, out = np.repeat(text, many), np.repeat(piece, many)
            for i, c in zip(low.tolist(), (-1 - piece[low]).tolist(), strict=True):
                out[starts[i] : starts[i] + many[i]] = self.m.byte_ids[list(raw[c])]
            piece = out
        return piece.astype(np.int32), np.searchsorted(text, np.arange(self.texts), side="right")


SAMPLE = "struct<ids:binary,pieces:int,log_p:double,log_inclusion:double>"


def segmentations(texts: list[str], keys: np.ndarray, path: str = VOCABULARY, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> list[list[dict]]:
    """For each text up to k samples, by falling Gumbel value: ids (int32, little endian), pieces, log_p, log_inclusion.

    Both logarithms are rounded to six places, as their last bits depend on what other texts are in a step.
    """
    s = Search(texts, keys, model(path), k, alpha, seed)
    out: list[list[dict]] = [[] for _ in texts]
    for number, p in enumerate(s.paths):
        ids, ends = s.ids(number)
        raw, begin = ids.tobytes(), 0
        over = p.log_p - s.threshold
        with np.errstate(over="ignore", divide="ignore"):
            score = np.where(over < -30, over, np.log(-np.expm1(-np.exp(np.minimum(over, 700)))))
        for i, end in enumerate(ends.tolist()):
            if s.has[number][i]:
                out[i].append({"ids": raw[4 * begin : 4 * end], "pieces": end - begin, "log_p": round(float(p.log_p[i]), 6), "log_inclusion": round(float(score[i]), 6)})
            begin = end
    return out


def encode(docs: DataFrame, keep: list[str], path: str = VOCABULARY, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, check: bool = False) -> DataFrame:
    """`keep` columns and samples: up to k distinct segmentations of the text, without replacement.

    With check also exact: whether all samples decode to the text (null for a null text).

    The row key is doc_id: rows with the same doc_id and text get the same samples; rows with a null doc_id share a
    key. A null text has null samples, an empty one the one segmentation of its leading space; a text of which there
    are fewer segmentations has fewer samples. The file at `path` must be there on every machine. ValueError if a kept
    column is named samples or exact. Empty table: no rows.
    """
    if clash := set(keep) & {"samples", *["exact"] * check}:
        raise ValueError(f"kept columns have names of new ones: {sorted(clash)}")
    text, key = free_name(docs, "_text"), free_name(docs, "_key")

    def run(batches):
        kind = pa.list_(pa.struct([("ids", pa.binary()), ("pieces", pa.int32()), ("log_p", pa.float64()), ("log_inclusion", pa.float64())]))
        for b in batches:
            texts, keys = b[text].to_pylist(), b[key].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for x, z in steps([len(t or "") + 1 for t in texts], STEP):
                at = [i for i in range(x, z) if texts[i] is not None]
                made = iter(segmentations([texts[i] for i in at], keys[at], path, k, alpha, seed) if at else [])
                out = [next(made) if texts[i] is not None else None for i in range(x, z)]
                more = []
                if check:
                    more = [pa.array([None if s is None else all(decode_ids(y["ids"], model(path)) == t for y in s) for s, t in zip(out, texts[x:z], strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(b[c].slice(x, z - x) for c in keep), pa.array(out, kind), *more], [*keep, "samples", *["exact"] * check])

    frame = docs.select(*keep, F.col("text").alias(text), F.xxhash64("doc_id").alias(key))
    return in_small_batches(frame).mapInArrow(run, "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + f"samples array<{SAMPLE}>" + ", exact boolean" * check)


def decode_ids(ids: bytes, m: Model) -> str:
    """The text of a segmentation, without the space that encoding puts in front."""
    return b"".join(map(m.bytes.__getitem__, np.frombuffer(ids, np.int32).tolist()))[1:].decode("utf-8", "replace")


def decode(coded: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """`keep` columns and decoded: the texts of the samples; null for null."""

    def run(batches):
        m = model(path)
        for b in batches:
            out = [None if s is None else [decode_ids(x["ids"], m) for x in s] for s in b["samples"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(out, pa.list_(pa.string()))], [*keep, "decoded"])

    return in_small_batches(coded).mapInArrow(run, "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in keep) + "decoded array<string>")
