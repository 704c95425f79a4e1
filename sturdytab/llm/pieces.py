"""SentencePiece encoding and decoding: segmentations drawn by forward filtering and backward sampling.

Lattice. A text gets a leading space, as the vocabulary expects, and a space is written as U+2581. Nodes are the places
between code points, arcs the pieces that fit; a code point that is no piece (U+2581 of the text itself included) is one
arc made of its UTF-8 byte pieces. The vocabulary holds merge ranks, so the weight of rank r is (r + 2)^-`POWER`, times a
constant per code point that changes no probability. A segmentation's probability is its pieces' product of weights,
normalised. No piece holds a line feed, or a space behind another character (`Pieces` refuses a vocabulary that has such a
piece). So no piece crosses the border of a unit, which is a line feed or a run of spaces with the word behind it, and drawing
units independently draws from the lattice of the whole text. Units may have any length: sums of ways carry a binary exponent
at each node, and a unit's lattice takes memory in proportion to its length.

Draws. Forward filtering sums the weights of all ways to each node; backward sampling walks from a unit's end and picks
each arc by its share. The random numbers are a hash of (seed, row key, unit, step), so a row's segmentation does not
depend on partitioning, order or retries, and equal units differ from place to place. Lattices of seen units are kept.

Decoding joins the pieces, writes U+2581 pieces as spaces, byte pieces as bytes, and drops the leading space: any text
comes back exactly. `encode` does so itself if asked for a check, so that neither text nor pieces go to a second Python worker.
An empty text has no pieces; a null text has null pieces and comes back null. A null key counts as
key -1. Rows with equal key and text get equal segmentations. An empty table gives an empty result. Unpaired surrogates
cannot occur in a DataFrame's strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, no_clash, slices, trimmed

POWER = 1.0
SEED = 17
SPACE = "▁"
PER_CODE_POINT = 100.0  # keeps products of some dozens of code points inside the range of doubles
PLAIN = 64  # code points of a unit whose sums need no exponents
FEW = 8  # units that are walked one by one
ADDED = 40_000  # code points of units put into lattices at once, or one unit
SLICE_BYTES = 250_000  # text whose units are drawn at once: a draw takes some dozens of bytes for each of these
BYTE_WEIGHT = 1e-6
CACHED_ARCS = 2_500_000
UNITS = re.compile(r"\n| *[^ \n]+| +")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each id; kind 0 normal, 1 byte, 2 control or unknown. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i), 1 if model.is_byte(i) else
             2 if model.is_control(i) or model.is_unknown(i) else 0) for i in range(model.vocab_size())]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(row: np.ndarray, unit: np.ndarray, step: np.ndarray, seed: int) -> np.ndarray:
    """Draws of some rows' units at one step, or of one unit at several steps."""
    h = mixed(np.atleast_1d(row) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    h = mixed(h ^ ((unit << np.uint64(32)) + step))
    return ((h >> np.uint64(40)) * 2.0**-24).astype(np.float32)


class Pieces:
    """Prefix tables of the vocabulary: for each length the hashes of all prefixes and the pieces among them."""

    BASE = np.uint64(0x100000001B3)

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.bytes = np.full(256, -1, np.int64)
        by_length: dict[int, dict[int, tuple[int, float]]] = {}
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == 1:
                self.bytes[int(piece[3:5], 16)] = i
            if kind:
                continue
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} goes on behind a word: {piece!r}")
            h = 0
            for n, c in enumerate(piece, 1):
                # a space is 32 in the lattice, so that U+2581 of a text is never taken for one
                h = ((h ^ (32 if c == SPACE else ord(c))) * int(self.BASE) + n) % 2**64
                found = by_length.setdefault(n, {}).setdefault(h, (-1, 0.0))
                if n == len(piece):
                    by_length[n][h] = (i, (2.0 - score) ** -POWER * PER_CODE_POINT**n)
                elif found[0] < 0:
                    by_length[n][h] = found
        self.tables = []
        for n in sorted(by_length):
            keys = np.array(sorted(by_length[n]), np.uint64)
            rows = [by_length[n][k] for k in keys.tolist()]
            self.tables.append((keys, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))

    def arcs(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, piece, weight) of every arc; `left` counts the code points to the unit's end."""
        place = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for n, (keys, ids, weights) in enumerate(self.tables, 1):
            h = (h ^ codes[place + n - 1]) * self.BASE + np.uint64(n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            if n == 1:
                hit &= codes[place] != 0x2581
                bare = place[~hit | (ids[at] < 0)]
                for x, y in zip(out, (bare, np.ones(len(bare), np.int64), -1 - codes[bare].astype(np.int64),
                                      np.full(len(bare), BYTE_WEIGHT * PER_CODE_POINT)), strict=True):
                    x.append(y)
            whole = hit & (ids[at] >= 0)
            for x, y in zip(out, (place[whole], np.full(whole.sum(), n), ids[at[whole]], weights[at[whole]]),
                            strict=True):
                x.append(y)
            more = hit & (left[place] > n)
            place, h = place[more], h[more]
            if not len(place):
                break
        return tuple(np.concatenate(x) for x in out)


class Lattices(dict):
    """Unit -> its last node. Nodes hold their incoming arcs with cumulative probabilities."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.first = np.zeros(1, np.int32)  # first arc of each node; node 0 is no node
        self.steps = np.zeros(0, np.int8)  # nodes an arc goes back
        self.ids = np.zeros(0, np.int32)
        self.upto = np.zeros(0, np.float32)
        self.depth = np.zeros(1, np.int32)  # code points between the unit's start and the node

    def add(self, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        depth = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        start, length, ids, weight = self.pieces.arcs(codes, np.repeat(lengths, lengths) - depth)
        end = start + length - 1  # the node after code point i has number i
        # by depth, then node, then length: the order of a node's arcs is the same in every task
        order = np.argsort(((depth[end] * len(codes) + end) << 5) + length)
        end, start, length = end[order], start[order], length[order]
        runs = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        share, ways = weight[order], np.zeros(len(codes) + 1)
        # beyond PLAIN code points the ways to a node are ways * 2^power; node d of a unit follows its node d - 1
        power = np.zeros(len(codes) + 1, np.int64) if depth.max() >= PLAIN else None
        edges = np.searchsorted(depth[end], np.arange(depth.max() + 2))
        run_edges = np.searchsorted(runs, edges)
        total = np.zeros(len(codes)) if power is not None else ways  # the sum that a node's shares are parts of
        for a, b, x, y in zip(edges, edges[1:], run_edges, run_edges[1:], strict=False):
            inner = depth[start[a:b]] > 0
            share[a:b] *= np.where(inner, ways[start[a:b] - 1], 1.0)
            nodes = end[runs[x:y]]
            if power is None:
                ways[nodes] = np.add.reduceat(share[a:b], runs[x:y] - a)
                continue
            before = np.where(depth[end[a:b]] > 0, power[end[a:b] - 1], 0)
            share[a:b] = np.ldexp(share[a:b], np.where(inner, power[start[a:b] - 1], 0) - before)
            total[nodes] = np.add.reduceat(share[a:b], runs[x:y] - a)
            ways[nodes], more = np.frexp(total[nodes])
            power[nodes] = before[runs[x:y] - a] + more
        share /= total[end]
        upto = np.cumsum(share)
        sizes = np.diff(runs, append=len(end))
        upto -= np.repeat(upto[runs] - share[runs], sizes)
        upto[runs + sizes - 1] = 2.0  # rounding never runs past a node's last arc
        first = np.empty(len(codes), np.int32)
        first[end[runs]] = runs + len(self.ids)
        self.update(zip(units, (len(self.first) - 1 + ends).tolist(), strict=True))
        self.first = np.concatenate((self.first, first))
        self.steps = np.concatenate((self.steps, length.astype(np.int8)))
        self.ids = np.concatenate((self.ids, ids[order].astype(np.int32)))
        self.upto = np.concatenate((self.upto, upto.astype(np.float32)))
        self.depth = np.concatenate((self.depth, (depth + 1).astype(np.int32)))

    def sample(self, units: list[str], row: np.ndarray, number: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units one after another, pieces per unit); a piece -1 - c stands for code point c in bytes."""
        if len(self.ids) > CACHED_ARCS:
            self.reset()
        new = sorted(set(units).difference(self), key=len)
        upto = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        i = 0
        while i < len(new):
            held = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, held + ADDED, "right")))
            self.add(new[i:j])
            i = j
        node = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        live, counts, drawn, step = np.arange(len(units)), np.zeros(len(units), np.int64), [], 0
        while len(live) > FEW:
            u = uniform(row[live], number[live], np.uint64(step), seed)
            arc = self.first[node]
            behind = np.flatnonzero(self.upto[arc] <= u)
            while len(behind):
                arc[behind] += 1
                behind = behind[self.upto[arc[behind]] <= u[behind]]
            drawn.append((live, self.ids[arc]))
            back = self.steps[arc]
            on = self.depth[node] > back
            counts[live[~on]] = step + 1
            live, node, step = live[on], (node - back)[on], step + 1
        rest = {}
        for who, end in zip(live.tolist(), node.tolist(), strict=True):
            rest[who] = self.walk(end, row[who], number[who], step, seed)
            counts[who] = step + len(rest[who])
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - k] = ids
        for who, ids in rest.items():
            out[ends[who] - counts[who]:ends[who] - step] = ids[::-1]
        return out, counts

    def walk(self, node: int, row: np.uint64, number: np.uint64, step: int, seed: int) -> list[int]:
        """One unit's pieces from a node back to its start, last piece first; the draws are those of `sample`."""
        found, draws, left = [], iter(()), self.depth[node]
        while left > 0:
            u = next(draws, None)
            if u is None:
                ahead = np.arange(step, step + min(int(left), 4096), dtype=np.uint64)
                draws, step = iter(uniform(row, number, ahead, seed)), step + len(ahead)
                continue
            arc = self.first[node]
            while self.upto[arc] <= u:
                arc += 1
            found.append(int(self.ids[arc]))
            back = int(self.steps[arc])
            node, left = node - back, left - back
        return found


def units_of(text: str) -> list[str]:
    return UNITS.findall(" " + text)


def in_bytes(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Code points that are no piece, written as byte pieces; `counts` are pieces per row."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, counts
    codes, which = np.unique(-1 - ids[bare], return_inverse=True)
    spelled = [pieces.bytes[list(chr(c).encode())] for c in codes.tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[bare] = np.array([len(s) for s in spelled])[which]
    ends = np.cumsum(sizes)
    out = np.repeat(ids, sizes)
    for k, s in enumerate(spelled):
        for j, b in enumerate(s):
            out[(ends - sizes)[bare[which == k]] + j] = b
    row_ends = np.cumsum(counts)
    upto = np.concatenate(([0], ends))[row_ends]
    return out, np.diff(upto, prepend=0)


def encode(docs: DataFrame, vocabulary: list[tuple[str, float, int]], id_col: str = "doc_id", text_col: str = "text",
           seed: int = SEED, carry: tuple[str, ...] = (), check: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, pieces (array of ids), then the carried columns. `check` names a last column: do the pieces
    decode to the very text? A null text counts as whole."""
    need(docs, id_col, text_col, *carry)
    bounded_batches(docs.sparkSession)
    no_clash([id_col, *carry], ["pieces", *([check] if check else [])])
    checked = check is not None
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(Pieces(shared.value))
        table = written(shared.value) if checked else []
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            keys = np.array([-1 if k is None else k for k in batch.column("key").to_pylist()], np.int64)
            split = [units_of(x) if x else [] for x in texts]
            per_row = np.array([len(x) for x in split])
            first = np.cumsum(per_row) - per_row
            units = [u for x in split for u in x]
            number = np.arange(len(units)) - np.repeat(first, per_row)
            ids, counts = lattices.sample(units, np.repeat(keys, per_row).view(np.uint64), number.astype(np.uint64), seed)
            sums = np.concatenate(([0], np.cumsum(counts)))
            ids, counts = in_bytes(ids, sums[first + per_row] - sums[first], lattices.pieces)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32),
                               mask=np.array([x is None for x in texts] + [False]))
            columns = {"row": batch.column("row"), "pieces": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))}
            if checked:
                ends = np.cumsum(counts)
                columns["whole"] = pa.array([x is None or decoded(ids[a:b].tolist(), table) == x for x, a, b in
                                             zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.struct(F.col(id_col), *(F.col(c) for c in carry)).alias("row"),
                       F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(trimmed(run), f"row {rows.schema['row'].dataType.simpleString()}, pieces array<int>"
                          + (", whole boolean" if checked else ""))
    return out.select(F.col("row").getField(id_col).alias(id_col), "pieces",
                      *(F.col("row").getField(c).alias(c) for c in carry), *([F.col("whole").alias(check)] if checked else []))


def written(vocabulary: list[tuple[str, float, int]]) -> list[bytes]:
    """The bytes that each id stands for."""
    return [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace(SPACE, " ").encode()
            for p, _, kind in vocabulary]


def decoded(ids: list[int], table: list[bytes]) -> str:
    return b"".join([table[i] for i in ids])[1:].decode()


def decode(encoded: DataFrame, vocabulary: list[tuple[str, float, int]], pieces_col: str = "pieces",
           into: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the text of its pieces. Control pieces stand for nothing."""
    need(encoded, pieces_col)
    bounded_batches(encoded.sparkSession)
    no_clash(encoded.columns, [into])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = written(shared.value)
        for batch in batches:
            lists = batch.column("pieces")
            ids, null = lists.values.to_numpy(), lists.is_null().to_pylist()
            at = lists.offsets.to_numpy().tolist()
            # one row's ids at a time become Python integers
            texts = [None if null[k] else decoded(ids[at[k]:at[k + 1]].tolist(), table) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("pieces"), pa.array(texts, pa.string())],
                                             names=["row", "pieces", "text"])

    others = [c for c in encoded.columns if c != pieces_col]
    rows = encoded.select(F.struct(F.lit(0).alias("any"), *(F.col(c) for c in others)).alias("row"),
                          F.col(pieces_col).alias("pieces"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, pieces array<int>, text string")
    return out.select(*(F.col("pieces").alias(c) if c == pieces_col else F.col("row").getField(c).alias(c)
                        for c in encoded.columns), F.col("text").alias(into))
