"""Toxicity: a logistic classifier whose scores are held equal under swaps of identity terms.

Features of a text: its distinct words (letter runs, lower-cased) and word beginnings of 4, 5 and 6 letters, hashed to
`BUCKETS`; identity terms have a feature of their own and no beginnings. Only presence counts, so a long text is
judged by what it says, not by its length.

Fit. On labelled rows, about `FIT_ROWS` of them at most. `sample_labelled` chooses ids by their hash before texts are
joined, so what it broadcasts is of that size whatever the tables hold and no text is shuffled; `fit_toxicity` chooses
by the hash of the text where it is given more. Equal label rows of one id are one row with a weight. Feature counts per
label are summed in Spark: first those of the toxic rows, then, for features that at least `LEAST` of them hold, those of the
others. The `SELECTED` features with the highest signed chi-square are kept; only these come to the driver, per row,
equal rows as one with a weight.
The loss is the log loss + L2 * |w|^2 + SWAP * the mean squared change of the linear score when an identity term of a
labelled text is swapped for each other term of its group (an implicit counterfactual copy). It is minimised by
accelerated gradient descent. The swaps pull the weights of a group's terms together, neutral ones included, so that
mentioning a group that toxic texts name often does not by itself raise a text's score.

Score: the logistic function of the linear score, between 0 and 1; texts without known features, empty and null texts
get the intercept's. Rows without text or label teach nothing; label 1 is toxic. If there is no labelled row, or one
label only, the score is that label's share (0.5 without any). Repeated rows count as often as they stand. Null ids are
ids like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sturdytab.llm.common import bounded_batches, need, no_clash, slices
from sturdytab.session import settle

FIT_ROWS = 60_000
BUCKETS = 1 << 20
LEAST = 4
SELECTED = 4_000
L2 = 0.5
SWAP = 1.0
STEPS = 400
THRESHOLD = 0.3
CACHED_WORDS = 100_000
HASHES = 1 << 62
LETTERS = re.compile(r"[^\W\d_]+")

# Groups of identity terms that may stand for each other; the first term of each is neutral.
IDENTITY = [
    "people women men girls boys transgender nonbinary females males".split(),
    "person woman man girl boy female male".split(),
    "believers christians muslims jews hindus buddhists sikhs atheists catholics protestants".split(),
    "religious christian muslim jewish hindu buddhist sikh atheist catholic protestant".split(),
    "human black white asian african european latino hispanic arab indigenous".split(),
    "straight gay lesbian bisexual queer homosexual heterosexual".split(),
    "adult old young elderly disabled deaf blind".split(),
    "citizens immigrants refugees foreigners natives".split(),
    "language english german french spanish chinese russian turkish polish indian".split(),
]
GROUP_OF = {term: k for k, terms in enumerate(IDENTITY) for term in terms}


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature, 5) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    if word in GROUP_OF:
        return [bucket("=" + word)]
    return [bucket("=" + word), *(bucket(word[:n]) for n in (4, 5, 6) if len(word) >= n)]


class Features(dict):
    """Word -> its features, for words seen before."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = word_features(word)
        return value


def text_features(text: str | None, known: Features) -> np.ndarray:
    """Distinct features of a text."""
    found: set[int] = set()
    for word in set(LETTERS.findall(text.lower())) if text else ():
        found.update(known[word])
    return np.fromiter(found, np.int64, len(found))


@dataclass
class ToxicModel:
    weights: dict[int, float] = field(default_factory=dict)
    intercept: float = 0.0


def counted(rows: DataFrame, wanted: np.ndarray | None) -> np.ndarray:
    """Weight of the texts that hold each feature, over all rows; of the wanted features only, if they are given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            for text, times in zip(batch.column("text").to_pylist(), batch.column("times").to_pylist(), strict=True):
                total[text_features(text, known)] += times
        at = np.flatnonzero(total if wanted is None else total * wanted)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    got = rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    got = (got.where(F.col("n") >= LEAST) if wanted is None else got).toArrow()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("feature").to_numpy()] = got.column("n").to_numpy()
    return counts


def swap_matrix(mentions: np.ndarray, terms: list[str]) -> np.ndarray:
    """Quadratic form of the swap penalty: sum over mentions and swaps of (w[term] - w[other])^2, over all texts."""
    form = np.zeros((len(terms), len(terms)))
    for a, term in enumerate(terms):
        others = [b for b, x in enumerate(terms) if GROUP_OF[x] == GROUP_OF[term] and b != a]
        for b in others:
            n = mentions[a] / len(others)
            form[a, a] += n
            form[b, b] += n
            form[a, b] -= n
            form[b, a] -= n
    return form


def minimise(row: np.ndarray, column: np.ndarray, label: np.ndarray, times: np.ndarray, width: int, form: np.ndarray,
             swap: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised log loss; row i counts times[i] times, the first len(form) columns are the
    identity terms."""
    n = len(label)
    share = np.average(label, weights=times)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    ahead, ahead_b, pace = w.copy(), b, 1.0
    per_row = np.bincount(row, minlength=n)
    steepness = 0.25 * (np.bincount(column, (times * per_row)[row], width).max(initial=0) + times.sum()) + 2 * L2
    if len(form):
        steepness += 2 * swap * np.abs(form).sum(axis=1).max()
    for _ in range(STEPS):
        linear = np.bincount(row, ahead[column], n) + ahead_b
        error = times * (1 / (1 + np.exp(-np.clip(linear, -500, 500))) - label)
        slope = np.bincount(column, error[row], width) + 2 * L2 * ahead
        slope[:len(form)] += 2 * swap * (form @ ahead[:len(form)])
        new, new_b = ahead - slope / steepness, ahead_b - error.sum() / steepness
        after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, ahead_b = new + (pace - 1) / after * (new - w), new_b + (pace - 1) / after * (new_b - b)
        w, b, pace = new, new_b, after
    return w, b


def hash_below(key: Column, share: float) -> Column:
    """True for that share of all keys."""
    return F.pmod(F.xxhash64(key), F.lit(HASHES)) < F.lit(int(min(1.0, share) * HASHES))


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """(text, label, times) of the labelled documents, of about `rows` (id, label) pairs at most. Null ids never match."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label in (0, 1)")
    known = settle(known.groupBy("id", "label").agg(F.count("*").alias("times")), "labels")
    n = known.count()
    drawn = known.where(hash_below(F.col("id"), rows / n if n else 1.0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("text", "label", "times")  # about `rows` pairs are broadcast


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS,
                 swap: float = SWAP, times_col: str | None = None) -> ToxicModel:
    need(labelled, text_col, label_col, *([times_col] if times_col else []))
    bounded_batches(labelled.sparkSession)
    given = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"),
                            (F.col(times_col) if times_col else F.lit(1)).cast("long").alias("times")).where(
        "text is not null and label in (0, 1) and times > 0")
    given = settle(given, "labelled")  # what joins texts and labels runs once, not once a pass

    def weights_of(df: DataFrame) -> tuple[dict[int, int], int]:
        got = df.groupBy("label").agg(F.sum("times").alias("times"), F.count("*").alias("n")).collect()
        return {r["label"]: r["times"] for r in got}, sum(r["n"] for r in got)

    sizes, n = weights_of(given)
    if len(sizes) < 2:
        share = 0.5 if not n else 0.999 if 1 in sizes else 0.001
        return ToxicModel({}, float(np.log(share / (1 - share))))
    sample = given.where(hash_below(F.col("text"), rows / n))
    toxic = counted(sample.where("label = 1").select("text", "times"), None)
    clean = counted(sample.where("label = 0").select("text", "times"), toxic > 0)
    sizes, _ = weights_of(sample)
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    held = (toxic + clean).astype(float)
    expected = held * yes / max(1, yes + no)
    gain = np.where(held > 0, (toxic - expected) * np.abs(toxic - expected) / np.maximum(expected, 1e-9), 0.0)
    terms = sorted(GROUP_OF)
    own = [bucket("=" + t) for t in terms]
    gain[own] = 0
    best = np.argsort(-gain, kind="stable")[:SELECTED]
    chosen = np.array([*own, *best[gain[best] > 6.0].tolist()])
    place = {f: k for k, f in reversed(list(enumerate(chosen.tolist())))}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in slices(batches, "text"):
            lists = [sorted({place[f] for f in text_features(t, known).tolist() if f in place})
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int32())), batch.column("label"), batch.column("times")],
                names=["features", "label", "times"])

    got = sample.mapInArrow(reduced, "features array<int>, label int, times long").groupBy("features", "label").agg(
        F.sum("times").alias("times")).orderBy("features", "label").toArrow()  # ordered: every run fits alike
    lists = got.column("features").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    column = lists.flatten().to_numpy().astype(np.int64)
    label, times = (got.column(c).to_numpy().astype(float) for c in ("label", "times"))
    if len(set(label.tolist())) < 2:  # the drawn rows have one label only
        share = 0.999 if yes else 0.001
        return ToxicModel({}, float(np.log(share / (1 - share))))
    mentions = np.bincount(column, times[row], len(chosen))[:len(terms)]
    w, b = minimise(row, column, label, times, len(chosen), swap_matrix(mentions, terms), swap)
    weights: dict[int, float] = {}
    for f, x in zip(chosen.tolist(), w.tolist(), strict=True):
        if x:
            weights[f] = weights.get(f, 0.0) + x
    return ToxicModel(weights, b)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, score, then the carried columns."""
    need(docs, id_col, text_col, *carry)
    bounded_batches(docs.sparkSession)
    no_clash([id_col, *carry], ["score"])
    weights, intercept = dict(model.weights), model.intercept  # at most SELECTED + the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, tuple[int, ...]] = {}  # word -> its features with a weight

        def heavy(word: str) -> tuple[int, ...]:
            value = told[word] = tuple(f for f in word_features(word) if f in weights)
            return value

        for batch in slices(batches, "text"):
            scores = []
            for text in batch.column("text").to_pylist():
                found: set[int] = set()
                for word in set(LETTERS.findall(text.lower())) if text else ():
                    features = told.get(word)
                    found.update(heavy(word) if features is None else features)
                if len(told) > CACHED_WORDS:
                    told.clear()
                linear = intercept + sum(weights[f] for f in sorted(found))
                scores.append(float(1 / (1 + np.exp(-max(-500.0, min(500.0, linear))))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())],
                                             names=["row", "score"])

    rows = docs.select(F.struct(F.col(id_col), *(F.col(c) for c in carry)).alias("row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select(F.col("row").getField(id_col).alias(id_col), "score",
                      *(F.col("row").getField(c).alias(c) for c in carry))
