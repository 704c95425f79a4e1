"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores labels spans of mixed text.

Fit. From labelled rows: per language the frequencies of hashed character n-grams (1 to 4, word ends marked) and the
share of its letters in each script. At most about `FIT_ROWS` rows a language are used, those with the smallest
hashes of their text, so the choice does not depend on partitioning; counts are summed in Spark. The model is a table of
`BUCKETS` x languages.

Predict. A word is a run of letters, lower-cased. Its script leaves the languages that write at least 1 % of their
letters in it (all, if none does). Its score for a language is the sum of the log frequencies of its n-grams, at most
`SPREAD` below the best. Viterbi with a penalty of `SWITCH` for each change of language labels the words; runs of
one label are the spans. The text's language is the one with most letters, ties to the first by name, and its score is
that share of the letters.

`und` and score 0 for a null text, a text without letters, or a model without languages. Rows without text or language
teach nothing. Repeated rows and null ids are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, no_clash, slices

FIT_ROWS = 4_000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SWITCH = 10.0
SPREAD = 8.0
CACHED_WORDS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")

# First and last code point of the main Unicode blocks of each script.
SCRIPTS = [
    ("latin", [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("gurmukhi", [(0xA00, 0xA7F)]),
    ("gujarati", [(0xA80, 0xAFF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("kannada", [(0xC80, 0xCFF)]),
    ("malayalam", [(0xD00, 0xD7F)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("ethiopic", [(0x1200, 0x137F)]),
    ("khmer", [(0x1780, 0x17FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
OTHER = len(SCRIPTS)
EDGES = np.array(sorted((a, b, k) for k, (_, spans) in enumerate(SCRIPTS) for a, b in spans))


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Index of each code point's script; `OTHER` outside the table."""
    at = np.searchsorted(EDGES[:, 0], codes, "right") - 1
    inside = (at >= 0) & (codes <= EDGES[np.maximum(at, 0), 1])
    return np.where(inside, EDGES[np.maximum(at, 0), 2], OTHER)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words, and the script of each word: that of its first letter."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    space = codes == 32
    number = np.cumsum(space) - 1
    word, bucket = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= space[k:k + m]
        if n == 1:
            inner |= space
        else:
            inner |= space[:m] & space[n - 1:n - 1 + m] if n == 2 else False
        keep = np.flatnonzero(~inner)
        h = np.full(len(keep), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[keep + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        word.append(np.where(space[keep] | (n == 1), number[keep], number[keep]))
        bucket.append((h % np.uint64(BUCKETS)).astype(np.int64))
    first = np.flatnonzero(space)[:-1] + 1
    return np.concatenate(word), np.concatenate(bucket), scripts_of(codes[first].astype(np.int64))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: log frequency
    writes: np.ndarray  # scripts x languages: whether the language is a candidate

    def word_scores(self, words: list[str]) -> np.ndarray:
        word, bucket, script = grams(words)
        scores = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            scores[:, k] = np.bincount(word, self.table[bucket, k], len(words))
        allowed = self.writes[script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        scores[~allowed] = -np.inf
        return np.maximum(scores - scores.max(axis=1, keepdims=True), -SPREAD).astype(np.float32)


class Words(dict):
    """Row of each word in a growing table of scores; emptied between batches when it is full."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.scores = self.scores[:0]
        new = list(set(words).difference(self))
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            self.update(zip(part, range(len(self), len(self) + len(part)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.word_scores(part)))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word of several texts at once; the texts' words stand one after another."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    came = np.zeros(scores.shape, np.int16)  # label before, for each label of each word
    own = np.arange(scores.shape[1], dtype=np.int16)
    state = scores[starts[sizes > 0]].astype(np.float64)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with at least t words
    final = np.zeros(len(sizes), np.int64)
    for t in range(1, int(sizes[0])):
        n = live[t]
        if n < len(state):
            final[n:len(state)] = state[n:].argmax(axis=1)
            state = state[:n]
        best = state.argmax(axis=1)
        moved = state[np.arange(n), best] - switch
        change = moved[:, None] > state
        at = starts[:n] + t
        came[at] = np.where(change, best[:, None], own)
        state = np.where(change, moved[:, None], state) + scores[at]
        state -= state.max(axis=1, keepdims=True)
    final[:len(state)] = state.argmax(axis=1)
    at = final
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = live[t]
        place = starts[:n] + t
        labels[place] = at[:n]
        at[:n] = came[place, at[:n]] if t else at[:n]
    return labels


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from the rows with text and language, about `rows` of each language at most."""
    need(docs, text_col, lang_col)
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in given.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((OTHER + 1, 0), bool))
    chance = F.lit(1.0)
    for lang in languages:
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / sizes[lang]))).otherwise(chance)
    sample = given.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < chance * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            for lang, words in seen.items():
                if not words:
                    continue
                times = np.fromiter(words.values(), np.float64, len(words))
                word, bucket, script = grams(list(words))
                total = sums.setdefault(lang, np.zeros(BUCKETS + OTHER + 1))
                total[:BUCKETS] += np.bincount(bucket, times[word], BUCKETS)
                total[BUCKETS:] += np.bincount(script, times * [len(w) for w in words], OTHER + 1)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(total[at])], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS + OTHER + 1, len(languages)))
    place = F.lit(0)
    for k, lang in enumerate(languages):
        place = F.when(F.col("lang") == lang, F.lit(k)).otherwise(place)
    got = summed.select("bucket", place.alias("k"), "n").toArrow()  # at most BUCKETS rows a language
    counts[got.column("bucket").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
    table = np.log(counts[:BUCKETS] + 0.5) - np.log(counts[:BUCKETS].sum(axis=0) + 0.5 * BUCKETS)
    letters = counts[BUCKETS:]
    return LanguageModel(languages, table.astype(np.float32),
                         letters / np.maximum(letters.sum(axis=0), 1) >= 0.01)


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score, spans (lang, first word, after), then the carried columns."""
    need(docs, id_col, text_col, *carry)
    bounded_batches(docs.sparkSession)
    no_clash([id_col, *carry], ["lang_pred", "score", "spans"])
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("after", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.writes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        known = Words(own)
        names = np.array(own.languages, object)
        for batch in slices(batches, "text"):
            texts = [LETTERS.findall(x.lower()) if x else [] for x in batch.column("text").to_pylist()]
            lengths = np.array([len(x) for x in texts])
            words = [w for x in texts for w in x]
            if len(names) and words:
                at = known.rows(words)
                labels = viterbi(known.scores[at], lengths)
            else:
                labels = np.zeros(len(words), np.int16)
            letters = np.fromiter(map(len, words), np.int64, len(words))
            pred, score, spans, at = [], [], [], 0
            for n in lengths.tolist():
                if not n or not len(names):
                    pred.append("und"), score.append(0.0), spans.append([])
                    at += n
                    continue
                part = labels[at:at + n]
                held = np.bincount(part, letters[at:at + n], len(names))
                best = int(held.argmax())
                pred.append(names[best]), score.append(float(held[best] / held.sum()))
                edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [n])).tolist()
                spans.append([{"lang": names[part[a]], "first": a, "after": b}
                              for a, b in zip(edge, edge[1:], strict=False)])
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64()), pa.array(spans, span)],
                                             names=["row", "lang_pred", "score", "spans"])

    rows = docs.select(F.struct(F.col(id_col), *(F.col(c) for c in carry)).alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, "
                               "spans array<struct<lang:string,first:int,after:int>>")
    return out.select(F.col("row").getField(id_col).alias(id_col), "lang_pred", "score", "spans",
                      *(F.col("row").getField(c).alias(c) for c in carry))
