"""Byte-level BPE as a streaming transducer of bounded lookahead, and an incremental decoder from bytes to text.

Tokens of a prefix. A sequence of tokens is what the merges give for its bytes exactly if that holds for every two neighbours.
So each prefix of a word has one last token: the only one that ends there and goes with the last token of what is in front
of it (`compatible` replays the merges along the two edges that meet). `Stream` keeps the last token of each place.

Lookahead. Bytes still to come change earlier boundaries only along a chain of tokens that overlap by turns with
the tokens of the shorter text, and every merge across a boundary of the other side needs an earlier merge across the next one:
ranks fall from one overlap to the next. `lookahead` finds the longest such chain for the merge list, by dynamic programming over
(token, place inside), in the order of ranks. Tokens that end farther back than that, plus one longest token, never
change: they are emitted and their bytes forgotten, so a word of any length is held in constant memory.

Splitting into words is a stream, too: matches of the pattern near the end of what was read wait for the next characters,
and a run of one kind longer than `LONG` goes to a `Stream` as it comes. Added tokens are cut out first. Words of up to
`KEPT` code points are kept with their tokens. Code points that the tokenizer's own character tables
class otherwise than this machine's are found at loading, by asking it about those that Python's tables do not know.

Merges must be proper (parts made by earlier merges, every token by one merge); other files raise an error.

Decoding joins the bytes of a block of tokens at a time and passes them through a decoder that keeps the bytes of an unfinished
character; malformed bytes become U+FFFD. Ids without a token stand for nothing, added tokens for their own text.
A null text counts as empty and has no ids; null ids decode to null. Repeated rows give repeated results; the row
order, and a null or repeated id, play no part. An empty table gives an empty result. Carried columns must not have the results' names.
"""

from __future__ import annotations

import codecs
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, no_clash, raw_texts, slices, trimmed

CHUNK = 1 << 16  # code points read at once
LONG = 4096  # code points of a run from which it is streamed
KEPT = 64  # code points up to which a word's tokens are kept
CACHED = 250_000  # words of a generation, two of which are kept
BLOCK = 4096  # bytes a stream takes before it looks for tokens to emit
DECODED = 8192  # tokens decoded at once
NEVER = 1 << 40

# Fixed value: how text is split into words before merging.
LETTERS, NUMBERS = r"\p{L}", r"\p{N}"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
PATTERN_AHEAD = 3  # a match that ends so many code points before the end of what was read is settled


def byte_letters() -> dict[str, int]:
    """Fixed rule: printable bytes of Latin-1 stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def odd_points(split) -> list[int]:
    """Code points that `regex` calls letters or numbers and the tokenizer (`split`: text to word count) neither."""
    found = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and found.match(chr(c))]
    return [c for c in new if split("!" + chr(c)) == 1]


def spans_of(points: list[int]) -> str:
    """Inside of a character class."""
    cuts = [i for i in range(len(points)) if i == 0 or points[i] != points[i - 1] + 1]
    ends = [*cuts[1:], len(points)]
    return "".join(rf"\U{points[a]:08x}-\U{points[b - 1]:08x}" for a, b in zip(cuts, ends, strict=True))


def patterns(odd: list[int]) -> dict[str, str]:
    """The splitting pattern and, per kind of run, what continues it."""
    letter, number = [f"[{kind}--[{spans_of(odd)}]]" if odd else kind for kind in (LETTERS, NUMBERS)]
    other = rf"[^\s{letter}{number}]"
    full = PATTERN.replace("[^\\s{L}{N}]", other).replace("{L}", letter).replace("{N}", number)
    return {"words": "(?V1)" + full, "letter": f"(?V1){letter}*", "number": f"(?V1){number}*", "other": f"(?V1){other}*",
            "space": r"(?V1)\s*"}


class Merges:
    """What the merge list says about tokens and pairs; ids are those of the vocabulary."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.tokens, self.merges = tokens, merges
        self.pairs = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made = {c: r for r, (_, _, c) in enumerate(merges)}
        self.left: dict[int, tuple] = {}  # the tokens at a token's left edge while it is made, from its first byte on
        self.right: dict[int, tuple] = {}
        for t, b in tokens.items():
            if len(b) == 1 and t not in self.made:
                self.left[t] = self.right[t] = (t,)
        for a, b, c in merges:
            if a not in self.left or b not in self.left or c in self.left or tokens[a] + tokens[b] != tokens[c]:
                raise ValueError("merges are not proper")
            self.left[c], self.right[c] = (*self.left[a], c), (*self.right[b], c)

    def crossed(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair that merges across the boundary between tokens a and b, if any."""
        u, v, made, i, j = self.right[a], self.left[b], self.made, 0, 0
        next_u = made[u[1]] if len(u) > 1 else NEVER
        next_v = made[v[1]] if len(v) > 1 else NEVER
        while True:
            # of equal pairs the left one merges first
            r = self.pairs.get((u[i], v[j]))
            if r is not None and r < next_u and r <= next_v:
                return u[i], v[j]
            if next_u == next_v == NEVER:
                return None
            if next_u <= next_v:
                i += 1
                next_u = made[u[i + 1]] if i + 1 < len(u) else NEVER
            else:
                j += 1
                next_v = made[v[j + 1]] if j + 1 < len(v) else NEVER

    def reached(self) -> list[int]:
        """Tokens that their own bytes give."""
        good = {t for t in self.left if len(self.left[t]) == 1}
        for a, b, c in self.merges:
            if a in good and b in good and self.crossed(a, b) == (a, b):
                good.add(c)
        return sorted(good)

    def lookahead(self, good: list[int]) -> int:
        """Bytes behind a boundary on which it can depend: the longest chain of overlaps of falling rank."""
        ranks: dict[int, tuple] = {t: () for t, e in self.left.items() if len(e) == 1}
        for r, (a, b, c) in enumerate(self.merges):
            ranks[c] = (*ranks[a], r, *ranks[b])
        states = sorted((r, t, o + 1) for t in good for o, r in enumerate(ranks[t]))
        best: dict[bytes, int] = {}  # bytes that a chain can go on beyond these, with the ranks seen so far
        longest, i = 0, 0
        while i < len(states):
            rank, group = states[i][0], []
            while i < len(states) and states[i][0] == rank:
                _, t, o = states[i]
                b = self.tokens[t]
                group.append((b, o, len(b) - o + best.get(b[o:], 0)))
                i += 1
            for b, o, more in group:
                longest = max(longest, o + more)
                for n in range(1, o + 1):
                    if best.get(b[:n], -1) < o - n + more:
                        best[b[:n]] = o - n + more
        return longest


def load_tokenizer(path: str) -> dict:
    """Tables of a byte-level BPE in the tokenizers library's format. Read on the driver; plain values, to be broadcast."""
    import tokenizers

    spec = json.load(open(path, encoding="utf-8"))
    model, before = spec["model"], spec["pre_tokenizer"]
    known = (model["type"] == "BPE" and before["type"] == "ByteLevel" and before.get("use_regex", True)
             and not before["add_prefix_space"] and spec["normalizer"] is None
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                "byte_fallback", "ignore_merges")))
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if not known or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE")
    letters, vocab = byte_letters(), model["vocab"]
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = Merges(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
    good = merges.reached()
    pre = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    return {"tokens": tokens, "merges": merges.merges, "added": added, "reached": good, "lookahead": merges.lookahead(good),
            "odd": odd_points(lambda text: len(pre.pre_tokenize_str(text)))}


class Transducer(dict):
    """Tokens of words: a dictionary that fills itself. Long words are not kept, and of the others those used of late."""

    def __init__(self, tables: dict):
        super().__init__()
        self.merges = Merges(tables["tokens"], tables["merges"])
        self.ids = {tables["tokens"][t]: t for t in tables["reached"]}
        self.size = {t: len(tables["tokens"][t]) for t in tables["reached"]}
        ends: dict[bytes, set] = {}
        for b in self.ids:
            if len(b) > 2:
                ends.setdefault(b[-3:], set()).add(len(b))
        self.lengths = {b: sorted(n, reverse=True) for b, n in ends.items()}  # lengths of the tokens that end so
        self.safe = tables["lookahead"] + max(self.size.values())
        self.goes: dict[tuple, bool] = {}
        self.before: dict[str, tuple] = {}  # the generation before

    def compatible(self, a: int, b: int) -> bool:
        if len(self.goes) > CACHED:
            self.goes.clear()
        known = self.goes[(a, b)] = self.merges.crossed(a, b) is None
        return known

    def last_tokens(self, data: bytes, last: list, start: int) -> None:
        """Go on with `last` (the last token of each prefix, None for the empty one) from `start` bytes to all of `data`."""
        ids, by_end, goes = self.ids.get, self.lengths.get, self.goes.get
        for end in range(start + 1, len(data) + 1):
            # a single byte is always a token; it ends a prefix only if no longer one does
            for n in (*by_end(data[end - 3:end], ()), 2) if end > 2 else (2,):
                if n <= end:
                    t = ids(data[end - n:end])
                    if t is not None:
                        front = last[end - n]
                        if front is None:
                            break
                        known = goes((front, t))
                        if known or known is None and self.compatible(front, t):
                            break
            else:
                t = ids(data[end - 1:end])
            last.append(t)

    def back(self, last: list, end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]

    def __missing__(self, word: str) -> tuple:
        found = self.before.get(word)
        if found is None:
            data = word.encode()
            if len(word) > KEPT:
                stream = Stream(self)
                return (*stream.feed(data), *stream.finish())
            last: list = [None]
            self.last_tokens(data, last, 0)
            found = tuple(self.back(last, len(data)))
        self[word] = found
        return found

    def trim(self) -> None:
        """Words not asked for since the last time but one go."""
        if len(self) > CACHED:
            self.before = dict(self)
            self.clear()


class Stream:
    """One word, fed in parts of any size; holds no more than the lookahead, a longest token and a block."""

    def __init__(self, transducer: Transducer):
        self.of, self.data, self.last, self.held = transducer, b"", [None], 0

    def feed(self, data: bytes) -> list[int]:
        """Tokens that are settled by now."""
        out: list[int] = []
        for at in range(0, len(data), BLOCK):
            done = len(self.data)
            self.data += data[at:at + BLOCK]
            self.of.last_tokens(self.data, self.last, done)
            self.held = max(self.held, len(self.data))
            if len(self.data) > self.of.safe + BLOCK:
                end = len(self.data)
                while end > len(self.data) - self.of.safe:
                    end -= self.of.size[self.last[end]]
                out += self.of.back(self.last, end)
                # the token in front stays, as that of the empty prefix of what is held
                self.data, self.last = self.data[end:], self.last[end:]
        return out

    def finish(self) -> list[int]:
        out = self.of.back(self.last, len(self.data))
        self.data, self.last = b"", [None]
        return out


class Splitter:
    """A text, fed in parts of any size, to tokens."""

    def __init__(self, transducer: Transducer, tables: dict):
        self.words, self.added = transducer, tables["added"]
        self.plain = {k: regex.compile(p) for k, p in patterns([]).items()}
        self.full = {k: regex.compile(p) for k, p in patterns(tables["odd"]).items()}
        self.first_odd = tables["odd"][0] if tables["odd"] else sys.maxunicode + 1
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.reset()

    def reset(self) -> None:
        self.text, self.run, self.stream, self.use = "", None, None, self.plain

    def feed(self, text: str, final: bool = False) -> list[int]:
        """Tokens settled by now; `final` ends the text."""
        if self.use is self.plain and not text.isascii() and \
                np.frombuffer(text.encode("utf-32-le"), "<u4").max() >= self.first_odd:
            self.use = self.full
        out: list[int] = []
        text, at = self.text + text, 0
        if self.special:
            # one of two added tokens that start alike may still become the longer
            for m in self.special.finditer(text):
                if not final and m.end() == len(text) and any(t != m[0] and t.startswith(m[0]) for t in self.added):
                    break
                self.segment(text[at:m.start()], True, out)
                out.append(self.added[m[0]])
                at = m.end()
        rest, held = text[at:], ""
        if not final:
            for t in self.added:
                for n in range(min(len(t), len(rest)), len(held), -1):
                    if rest.endswith(t[:n]):
                        held = t[:n]
                        break
        rest = rest[:len(rest) - len(held)]
        self.text = self.segment(rest, final, out) + held
        if final:
            self.reset()
        return out

    def segment(self, text: str, final: bool, out: list[int]) -> str:
        """Tokens of a stretch without added tokens go to `out`; the end that may still change is returned."""
        if self.run:
            n = self.use[self.run].match(text).end()
            whole = n == len(text)
            taken = n if self.run != "space" or (whole and final) else max(n - 1, 0)
            out += self.stream.feed(text[:taken].encode())
            if whole and not final:
                return text[taken:]
            out += self.stream.finish()
            self.run, text = None, text[taken:]
        words = self.use["words"].findall(text)
        if final:
            self.look_up(words, out)
            return ""
        wait = 0
        while words and wait < PATTERN_AHEAD:
            wait += len(words.pop())
        self.look_up(words, out)
        rest = text[len(text) - wait:] if wait else ""
        if len(rest) > LONG:
            head = self.use["words"].match(rest)[0]
            if len(head) > LONG:  # its kind is that of its last character
                kind = next(k for k in ("space", "letter", "number", "other") if self.use[k].match(head[-1]).end())
                taken = len(head) - 1 if kind == "space" else len(head)
                if taken == len(rest) or kind == "space" and taken == len(rest) - 1:
                    self.run, self.stream = kind, Stream(self.words)
                    out += self.stream.feed(head[:taken].encode())
                    return rest[taken:]
        return rest

    def look_up(self, words: list[str], out: list[int]) -> None:
        out.extend(chain.from_iterable(map(self.words.__getitem__, words)))
        self.words.trim()


class TextDecoder:
    """Tokens, fed in parts of any size, to text; keeps the bytes of an unfinished character."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.state = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], final: bool = False) -> str:
        tokens = self.tokens
        text = self.state.decode(b"".join([tokens.get(i, b"") for i in ids]), final)
        if final:
            self.state.reset()
        return text


def encode(docs: DataFrame, tables: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
           packed: bool = False) -> DataFrame:
    """One row per row of `docs`: id, ids, n_tokens, then the carried columns. `ids` is an array, or with `packed` a
    binary value of little-endian unsigned 32-bit integers."""
    need(docs, id_col, text_col, *carry)
    no_clash([id_col, *carry], ["ids", "n_tokens"])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # the vocabulary's own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        if "transducer" not in tables:  # kept with a worker's copy of the tables, so its later tasks find its words
            tables["transducer"] = Transducer(tables)
        splitter = Splitter(tables["transducer"], tables)

        def ids_of(text: str) -> bytes:
            parts = [np.array(splitter.feed(text[i:i + CHUNK], i + CHUNK >= len(text)), "<u4").tobytes()
                     for i in range(0, max(len(text), 1), CHUNK)]
            return b"".join(parts)

        for batch in slices(batches, "text"):
            ids = [ids_of(b.decode()) for b in raw_texts(batch.column("text"))]
            counts = [len(b) // 4 for b in ids]
            if packed:
                column = pa.array(ids, pa.binary())
            else:
                offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), column, pa.array(counts, pa.int64())],
                                             names=["row", "ids", "n_tokens"])

    rows = docs.select(F.struct(F.col(id_col), *(F.col(c) for c in carry)).alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(trimmed(run), f"row {rows.schema['row'].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}, "
                               "n_tokens bigint")
    return out.select(F.col("row").getField(id_col).alias(id_col), "ids", "n_tokens",
                      *(F.col("row").getField(c).alias(c) for c in carry))


def decode(encoded: DataFrame, tables: dict, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the text of its ids, given as an array or packed."""
    need(encoded, ids_col)
    no_clash(encoded.columns, [into])
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {**shared.value["tokens"], **{i: t.encode() for t, i in shared.value["added"].items()}}
        decoder = TextDecoder(tokens)

        def text_of(value) -> str | None:
            if not value.is_valid:
                return None
            ids = np.frombuffer(value.as_buffer(), "<u4") if pa.types.is_binary(value.type) else value.values.to_numpy(zero_copy_only=False)
            parts = [decoder.feed(ids[i:i + DECODED].tolist()) for i in range(0, len(ids), DECODED)]
            return "".join([*parts, decoder.feed([], True)])

        for batch in batches:
            column = batch.column("ids")
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [text_of(column[start + k]) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())],
                                                 names=["row", "ids", "text"])

    others = [c for c in encoded.columns if c != ids_col]
    rows = encoded.select(F.struct(F.lit(0).alias("any"), *(F.col(c) for c in others)).alias("row"),
                          F.col(ids_col).alias("ids"))
    kind = rows.schema["ids"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids {kind}, text string")
    return out.select(*(F.col("ids").alias(c) if c == ids_col else F.col("row").getField(c).alias(c)
                        for c in encoded.columns), F.col("text").alias(into))
