"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark; words covered by a window
that also starts earlier are removed, and neighbouring windows merge into maximal removal intervals.

Order and ties. Windows are ordered by (doc_id, start); the first window of a word sequence stays. A null doc_id comes
before all others. Rows that share a doc_id are told apart by the CRC-32 of their text, in that order; equal rows
count as one document and get the same result. A null text has no words. Texts shorter than a window lose nothing.

How it runs. A task hashes its documents with numpy. Per chunk of documents only the first window of each hash is
shuffled, as (bucket, packed arrays): a passage that every document holds costs one entry a chunk, not one a row. Each
bucket finds hashes with several entries and deals the windows that are not the first, packed again, by document. One
row a document then meets the texts in a join, to which only texts that pass a filter of these documents are shuffled.

Exactness. Windows are equal if the 64-bit hash and the bucket, which comes from a second polynomial, agree. With b
windows in each of n buckets the chance of any false match is below n * b^2 / 2^65, 1e-5 for 10^8 windows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, give_back, maybe_among, need, no_clash, partitions, raw_texts, slices, trimmed
from sturdytab.session import settle

WINDOW = 20
CHUNK_WORDS = 600_000
BUCKET_BYTES = 16_000_000  # text whose windows fill one bucket: about two and a half million
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd, so powers never vanish
SHARES = 8  # parts of a bucket's keys that are sorted one after the other
NO_ID = -(2**63)  # stands for a null doc_id while sorting


class WordHashes(dict):
    """64-bit hash of a word, remembered for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of `width` words, modulo 2^64, built from runs of doubled length."""
    have, total = None, 0
    run, length, step = words, 1, np.array([base])
    while width:
        if width & 1:
            if have is not None:
                n = max(0, min(len(have), len(run) - total))
                have = have[:n] * step + run[total:total + n]
            else:
                have = run
            total += length
        width >>= 1
        if width:
            n = max(0, len(run) - length)
            run = run[:n] * step + run[length:length + n]
            step, length = step * step, length * 2
    return have


def pack_gaps(gaps: np.ndarray) -> tuple[bytes, bytes]:
    """One byte a gap; gaps over 254 go to a side list."""
    low = np.minimum(gaps, 255).astype(np.uint8)
    return low.tobytes(), gaps[gaps >= 255].astype(np.uint32).tobytes()


def unpack_gaps(low: bytes, high: bytes) -> np.ndarray:
    gaps = np.frombuffer(low, np.uint8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(high, np.uint32)
    return gaps


PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary()),
                    ("counts", pa.binary()), ("gaps", pa.binary()), ("far", pa.binary())])
PACKED_DDL = "bucket int, keys binary, docs binary, sums binary, counts binary, gaps binary, far binary"
LATER = pa.schema([("id", pa.int64()), ("sum", pa.int64()), ("starts", pa.list_(pa.int32()))])
LATER_DDL = "id long, sum long, starts array<int>"


def pack_rows(bucket: np.ndarray, keys: np.ndarray | None, doc: np.ndarray, start: np.ndarray,
              ids: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """One packed row a bucket. Entries are in (doc, start) order; `doc` indexes ids and sums. Without keys the windows
    are known not to be first."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for part in np.split(order, edges):
        if not len(part):
            continue
        d, s = doc[part], start[part]
        head = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        gaps = np.diff(s, prepend=0)
        gaps[head] = s[head]
        low, far = pack_gaps(gaps)
        counts = np.diff(head, append=len(d)).astype(np.uint32)
        rows.append((int(bucket[part[0]]), b"" if keys is None else keys[part].tobytes(),
                     np.diff(ids[d[head]], prepend=np.int64(0)).tobytes(),  # steps, which compress well
                     sums[d[head]].astype(np.uint32).tobytes(), counts.tobytes(), low, far))
    return rows


def unpack_row(row: dict) -> tuple[np.ndarray, ...]:
    """(keys, id, sum, start) of each entry."""
    counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
    gaps = unpack_gaps(row["gaps"], row["far"])
    run = np.cumsum(gaps)
    head = np.cumsum(counts) - counts
    start = (run - np.repeat(run[head] - gaps[head], counts)).astype(np.int32)
    return (np.frombuffer(row["keys"], np.uint64), np.repeat(np.cumsum(np.frombuffer(row["docs"], np.int64)), counts),
            np.repeat(np.frombuffer(row["sums"], np.uint32), counts), start)


def table_rows(table: pa.Table) -> Iterator[dict]:
    """Packed rows whose binaries stay where they are."""
    for batch in table.to_batches():
        columns = {n: batch.column(n) for n in PACKED.names if n != "bucket"}
        for i in range(batch.num_rows):
            yield {n: c[i].as_buffer() for n, c in columns.items()}


def windows_of(buckets: int, width: int):
    """Map side: packed rows of the first window of each hash in a chunk, and of the later ones, which are decided."""

    def chunk_rows(held: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
        held.sort(key=lambda x: x[:2])
        held = [x for i, x in enumerate(held) if i == 0 or x[:2] != held[i - 1][:2]]
        lengths = np.array([len(x[2]) for x in held])
        ids = np.array([x[0] for x in held], np.int64)
        sums = np.array([x[1] for x in held], np.int64)
        words = np.concatenate([x[2] for x in held])
        small = np.int32 if len(words) < 2**31 else np.int64
        doc = np.repeat(np.arange(len(held), dtype=small), lengths - (width - 1))
        first = (np.cumsum(lengths) - lengths).astype(small)
        place = np.arange(len(doc), dtype=small) + np.repeat(
            (width - 1) * np.arange(len(held), dtype=small), lengths - (width - 1))
        start = place - first[doc]
        keys = rolling(words, width, BASES[0])[place]
        bucket = ((rolling(words, width, BASES[1])[place] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
        del words, place
        order = np.argsort(keys, kind="stable").astype(small)
        new = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))
        ahead, behind = np.sort(order[new]), np.sort(order[~new])
        del order, new
        rows = pack_rows(bucket[ahead], keys[ahead], doc[ahead], start[ahead], ids, sums)
        if len(behind):  # dealt by document, so that no bucket gathers what a frequent window decides
            to = (doc[behind] % buckets).astype(np.int32)
            rows += pack_rows(to, None, doc[behind], start[behind], ids, sums)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, n = [], 0
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                words = text.split()
                if len(words) < width:
                    continue
                held.append((NO_ID if doc is None else doc, zlib.crc32(text),
                             np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
                n += len(words)
                if n >= CHUNK_WORDS:
                    yield packed_batch(chunk_rows(held))
                    held, n = [], 0
                    give_back()
        if held:
            yield packed_batch(chunk_rows(held))

    return run


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in rows], PACKED)


def later_windows(buckets: int):
    """Reduce side, one bucket: the windows that are not the first of their hash, packed and dealt by document."""

    def repeats(k: np.ndarray, place: list[np.ndarray]) -> list[np.ndarray]:
        """Of windows with these keys those that are not the first of theirs."""
        order = np.argsort(k, kind="stable")
        same = np.diff(k[order]) == 0
        o = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        k, (i, c, s) = k[o], (x[o] for x in place)
        o = np.lexsort((s, c, i, k))
        k, i, c, s = k[o], i[o], c[o], s[o]
        fresh = np.concatenate(([True], k[1:] != k[:-1]))[:len(k)]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
        later = (i != i[first]) | (c != c[first]) | (s != s[first])
        return [i[later], c[later], s[later]]

    def run(table: pa.Table) -> pa.Table:
        keys, found, decided = [], [], []
        for row in table_rows(table):
            k, *place = unpack_row(row)
            if len(k):
                keys.append(k), found.append(place)
            else:
                decided.append(place)
        if keys:
            k = np.concatenate(keys)
            keys.clear()
            place = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            share = (k >> np.uint64(40)).astype(np.uint8) % SHARES  # a part of the keys at a time, whose sorting needs little
            for number in range(SHARES):
                these = np.flatnonzero(share == number)
                if len(these):
                    decided.append(repeats(k[these], [x[these] for x in place]))
            del k, place, share
        if not sum(len(d[0]) for d in decided):
            return PACKED.empty_table()
        i, c, s, doc, head = by_document(decided)
        to = (i.astype(np.uint64) * BASES[0] >> np.uint64(40)) % np.uint64(buckets)
        out = pa.Table.from_batches([packed_batch(pack_rows(to.astype(np.int32), None, doc, s, i[head], c[head]))])
        del i, c, s, doc, head, to, decided
        give_back()
        return out

    return run


def by_document(places: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Windows (id, sum, start) in that order, the number of each one's document, and where documents begin."""
    i, c, s = (np.concatenate(x) for x in zip(*places, strict=True))
    order = np.lexsort((s, c, i))
    i, c, s = i[order], c[order], s[order]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (c[1:] != c[:-1])))[:len(i)]
    return i, c, s, np.cumsum(new) - 1, np.flatnonzero(new)


def per_document(table: pa.Table) -> pa.Table:
    """One row a document: the starts of its windows that are not the first."""
    i, c, s, _, head = by_document([unpack_row(row)[1:] for row in table_rows(table)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(i)).astype(np.int32)), pa.array(s))
    return pa.table([pa.array(i[head]), pa.array(c[head].astype(np.int64)), lists], schema=LATER)


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words; white space before a kept word stays as it was."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    parts, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    for a, b in edges.reshape(-1, 2):
        parts.append(text[at:spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    parts.append(text[at:])
    return b"".join(parts)


def removal(width: int, joined: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, spans, kept = [], [], [], []
            for text, later in zip(raw_texts(batch.column("text")), batch.column("later").to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if later is None:
                    n_removed.append(0), spans.append([])
                    kept.append(b" ".join(words) if joined else text)
                    continue
                starts = np.array(later, np.int64)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + width, -1)
                gone = np.cumsum(depth)[:-1] > 0
                n_removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans.append([{"first": int(a), "after": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if joined
                            else cut(text, gone))
            out = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                   pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())]
            if "carried" in schema.names:
                out.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   joined: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (word intervals [first, after) that go), kept_text, then the
    carried columns.

    `kept_text` is the text without those intervals, or with `joined` its kept words joined by one space. Columns not
    carried are ignored, whatever their names; a carried column may not have the name of a result. An empty table gives
    an empty result. See the module for nulls, ties and repeated rows.
    """
    need(docs, id_col, text_col, *carry)
    bounded_batches(docs.sparkSession)
    no_clash(list(carry), ["n_words", "n_removed", "spans", "kept_text"])
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        *([F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    packed = texts.select("id", "text").mapInArrow(trimmed(windows_of(buckets, window)), PACKED_DDL)
    later = packed.groupBy("bucket").applyInArrow(later_windows(buckets), PACKED_DDL)
    later = settle(later.groupBy("bucket").applyInArrow(per_document, LATER_DDL).select(
        F.col("id").alias("at"), "sum", F.col("starts").alias("later")), "later")
    place = F.coalesce(F.col("id"), F.lit(NO_ID))
    placed = maybe_among(texts.withColumns({"at": place, "sum": F.coalesce(F.crc32("text"), F.lit(0).cast("long"))}),
                         later, "at", "sum")
    met = placed.where("maybe").join(later, ["at", "sum"], "left").drop("at", "sum", "maybe").unionByName(
        placed.where("not maybe").drop("at", "sum", "maybe").withColumn("later", F.lit(None).cast("array<int>")))
    names = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
             ("spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), ("kept_text", pa.string())]
    ddl = "id long, n_words long, n_removed long, spans array<struct<first:int,after:int>>, kept_text string"
    if carry:
        names.append(("carried", pa.null()))
        ddl += f", carried {texts.schema['carried'].dataType.simpleString()}"
    out = met.mapInArrow(removal(window, joined, pa.schema(names)), ddl)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", "kept_text",
                      *(F.col("carried").getField(c).alias(c) for c in carry))
