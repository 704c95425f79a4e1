"""Steps of the near-dedup stage, and of substring dedup within a bucket."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sturdytab.llm import near_copies, substring_dedup


def test_near_copies_ask_the_fingerprints_first(spark):
    """A text and its copy with a word more are a pair by their SimHash fingerprints alone; others are not."""
    draw = np.random.default_rng(11)
    words = [" ".join(f"w{x}" for x in draw.integers(0, 5000, 600)) for _ in range(3)]
    texts = [words[0], words[0] + " more", words[1], words[2], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keyed = near_copies.mapped(docs, near_copies.described, "bands").cache()
    keys = {r.id: r.key for r in keyed.collect()}
    classes = keyed.groupBy("key").agg(F.min("id").alias("first"), F.first("bands").alias("bands"))
    pairs = [{r.hi, r.lo} for r in near_copies.fingerprint_pairs(classes).collect()]
    assert pairs == [{keys[0], keys[1]}]
    found = near_copies.near_copies(docs, "id").collect()
    assert sorted((r.id, r.component) for r in found) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]


def test_repeats_of_a_bucket_do_not_depend_on_its_shares():
    """One bucket, all windows: those that are not the first of their words, by brute force."""
    draw = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 3, 60)) for _ in range(12)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(12), pa.int64()), "text": texts})
    packed = pa.Table.from_batches(list(substring_dedup.windows_of(1, 3)(iter([batch]))))
    later = substring_dedup.later_windows(1)(packed)
    got = {(int(i), int(s)) for row in substring_dedup.table_rows(later)
           for i, s in zip(*substring_dedup.unpack_row(row)[1::2], strict=True)}
    seen, plain = set(), set()
    for i, text in enumerate(texts):
        words = text.split()
        for s in range(len(words) - 2):
            plain |= {(i, s)} if tuple(words[s:s + 3]) in seen else set()
            seen.add(tuple(words[s:s + 3]))
    assert got == plain and len(plain) > 300


def test_a_family_below_the_threshold_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts with a long passage in common, alike to 0.7 and linked by a few pairs only: the components of all pairs, from few comparisons."""
    draw = np.random.default_rng(13)

    def words(n):
        return [f"w{x}" for x in draw.integers(0, 10**6, n)]

    passage = words(200)
    texts = [passage + words(40) for _ in range(60)]
    texts += [texts[i][:-8] + words(8) for i in (3, 4)]  # like one of the others, beyond the passage
    cut = passage[:150]
    texts += [passage[i:i + 155] for i in (0, 22, 45)] + [cut, cut[:60] + words(1) + cut[60:]]  # alike by what they lack
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    compared, plain = [], near_copies.similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_copies, "similar", counted)
    got = {r.id: r.component for r in near_copies.near_copies(docs, "id").collect()}
    sets = [{" ".join(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts)
    assert compared[-1] < len(texts)


def test_bounds_under_a_lead_lose_no_link(spark):
    """Every linked pair of texts that a lead has near it is told, whatever they take from it, lack or add."""
    draw = np.random.default_rng(14)
    lead = draw.permutation(1000)[:100]
    sets = [lead]
    for _ in range(150):
        kept = draw.permutation(lead)[:draw.integers(55, 95)]
        sets.append(np.concatenate([kept, 1000 + draw.integers(0, 40, draw.integers(0, 30))]))
        sets.append(np.concatenate([sets[-1][:-3], [2000 + len(sets)]]))
    sets = [np.unique(s).astype(np.int64) for s in sets]
    same = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]

    def linked(i, j):
        return 9 * same[i][j] >= 4 * (len(sets[i]) + len(sets[j]))

    root = [0 if linked(i, 0) else i for i in range(len(sets))]
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "key long, value array<long>").cache()
    members = spark.createDataFrame([(i, 0, root[i]) for i in range(1, len(sets))], "hi long, lo long, root long")
    met = near_copies.met_leads(members, frame)
    got = {(r.hi, r.lo) for r in near_copies.meeting(met).collect()}
    want = {(i, j) for i in range(1, len(sets)) for j in range(1, i) if root[i] != root[j] and linked(i, j)}
    inside = [5 * same[i][0] >= 4 * len(sets[i]) for i in range(len(sets))]
    assert want <= got and len(want) > 50 and any(inside[i] and inside[j] for i, j in want)
