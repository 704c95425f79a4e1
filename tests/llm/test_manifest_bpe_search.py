"""Merkle manifest, byte-level BPE and ranked search against brute force."""

import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sturdytab.llm import bpe, lexical, merkle

# ---- manifest -----------------------------------------------------------------------------------


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def plain_path(levels, at):
    out = []
    for nodes in levels[:-1]:
        out += ["L" + nodes[at - 1]] if at % 2 else ["R" + nodes[at + 1]] if at + 1 < len(nodes) else ["-"]
        at //= 2
    return out


LEAVES = "tree string, k bigint, leaf string, pos_of int"


@pytest.mark.parametrize("step", [1, 2, 3, 8])
def test_manifest_and_proofs(spark, step):
    sizes = {None: 1, "": 5, "a": 64, "b": 37, "ä": 2, "z": 300}
    rows = [(t, k // 2 if k > 1 else None, h(f"{t} {k}"), k) for t, n in sizes.items() for k in range(n)]
    random.Random(3).shuffle(rows)
    manifest = merkle.build_manifest(spark.createDataFrame(rows, LEAVES), ["k"], carry=("pos_of",), step=step)
    got = merkle.extract_proofs(manifest, step).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn(
        "digest", merkle.siblings_digest(F.col("path"))).collect()
    assert len(got) == len(rows)
    trees = {t: sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for t in sizes}
    levels = {t: plain_levels([r[2] for r in rs]) for t, rs in trees.items()}
    names = sorted(sizes, key=lambda t: (t is not None, (t or "").encode()))
    top = plain_levels([levels[t][-1][0] for t in names])
    for r in got:
        path = plain_path(levels[r.tree], r.pos) + plain_path(top, names.index(r.tree))
        assert trees[r.tree][r.pos][2] == r.leaf and trees[r.tree][r.pos][3] == r.pos_of
        assert (r.subroot, r.root) == (levels[r.tree][-1][0], top[-1][0]) and r.folded == r.root
        assert r.path.split(" ") == path
        assert r.digest == h("".join(w[1:] for w in path))
    assert manifest.root.first().root == top[-1][0]


def test_manifest_of_one_leaf_and_of_none(spark):
    one = spark.createDataFrame([(None, 1, h("x"), 0)], LEAVES)
    got = merkle.extract_proofs(merkle.build_manifest(one, ["k"])).first()
    assert (got.leaf, got.root, got.path) == (h("x"), h("x"), "")
    assert one.select(merkle.fold(F.lit(h("x")), F.lit(""))).first()[0] == h("x")
    assert not merkle.extract_proofs(merkle.build_manifest(one.limit(0), ["k"])).collect()
    with pytest.raises(ValueError):
        merkle.build_manifest(one.withColumn("path", F.lit(1)), ["k"], carry=("path",))


def test_equal_rows_are_leaves_of_their_own(spark):
    got = merkle.extract_proofs(merkle.build_manifest(spark.createDataFrame([("a", 1, h("x"), 0)] * 3, LEAVES), ["k"])).collect()
    levels = plain_levels([h("x")] * 3)
    assert sorted(r.path for r in got) == sorted(" ".join(plain_path(levels, i)) for i in range(3))


def test_leaf_digest_tells_nulls_lengths_and_bytes(spark):
    rows = [(1, "a", "bc"), (1, "ab", "c"), (1, None, "-"), (1, "-", None), (None, "", "é" * 100_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "i int, a string, b string").select(
        merkle.leaf_digest(F.col("i"), F.col("a"), F.col("b"))).collect()]
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert got == [h("".join(map(value, r))) for r in rows] and len(set(got)) == 5


# ---- byte-level BPE -----------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "r", "l", "v", "e", "the", "1", "23", "!", "...", "---", "é", "Ж", "中", "😀",
        "\xa0", "<|endoftext|>", "<|endof", "é", "\U00010940", "՘", "====", "\x85", "\x1c", "　"]


@pytest.fixture(scope="module")
def tables():
    return bpe.load_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def in_parts(splitter, text, n):
    return [i for k in range(0, max(len(text), 1), n) for i in splitter.feed(text[k:k + n], k + n >= len(text))]


def test_streamed_tokens_equal_the_library(tables, library):
    splitter, draw = bpe.Splitter(bpe.Transducer(tables), tables), random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice(BITS) for _ in range(draw.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        for n in (1, 2, 5, 1 << 16):
            assert in_parts(splitter, text, n) == want, (text, n)


def test_joined_tokens_split_as_the_library_does(tables, library):
    words, draw = bpe.Transducer(tables), random.Random(2)
    letters = [b.decode() for b in tables["tokens"].values() if b.isascii() and b.isalpha()]
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 12)))
        assert list(words[text]) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 20_001 + "x", "x " + "\n " * 6000 + "<|endoftext|>" + " " * 5000, "-=" * 9000,
                                  "7" * 9000 + "a", "é" * 9000, "ÃÂ" * 6000, "ab'" * 5000])
def test_runs_of_any_length(tables, library, text):
    splitter = bpe.Splitter(bpe.Transducer(tables), tables)
    want = library.encode(text, add_special_tokens=False).ids
    for n in (999, 4099, 1 << 16):
        assert in_parts(splitter, text, n) == want


def test_a_stream_holds_no_more_than_its_lookahead(tables):
    words, draw = bpe.Transducer(tables), random.Random(4)
    data = "".join(draw.choice("etaoinshrdlu") for _ in range(60_000)).encode()
    stream, whole = bpe.Stream(words), [None]
    got = [t for k in range(0, len(data), 700) for t in stream.feed(data[k:k + 700])] + stream.finish()
    words.last_tokens(data, whole, 0)
    assert got == words.back(whole, len(data))
    assert stream.held <= words.safe + 2 * bpe.BLOCK


def test_lookahead_covers_every_change(tables):
    """No byte to come changes a token that ends farther back than the lookahead and one token; some are changed from afar."""
    words, draw, farthest = bpe.Transducer(tables), random.Random(5), 0
    tokens = [b for b in tables["tokens"].values() if b.isascii() and b.isalpha()]
    for _ in range(60):
        data, last = b"".join(draw.choice(tokens) for _ in range(40)), [None]
        words.last_tokens(data, last, 0)
        final = set(ends(words, last, len(data)))
        for n in range(1, len(data)):
            farthest = max([farthest, *(n - e for e in ends(words, last, n) if e not in final)])
    assert 0 < farthest <= words.safe


def ends(words, last, n):
    while n:
        yield n
        n -= words.size[last[n]]


def test_decoder_equals_the_library(tables, library):
    tokens = {**tables["tokens"], **{i: t.encode() for t, i in tables["added"].items()}}
    draw, decoder = random.Random(6), bpe.TextDecoder(tokens)
    for _ in range(200):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 60))]
        got = "".join(decoder.feed(ids[i:i + 3]) for i in range(0, len(ids), 3)) + decoder.feed([], True)
        assert got == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("packed", [True, False])
def test_encode_and_decode_tables(spark, tables, library, packed):
    rows = [(1, None, "x"), (None, "", None), (2, "same text", "x"), (2, "same text", "x"), (3, " \n\t ", "x"),
            (4, "word é <|endoftext|> " * 20_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens2 string")
    encoded = bpe.encode(docs, tables, carry=("n_tokens2",), packed=packed)
    got = bpe.decode(encoded, tables).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        ids = [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)] if packed else r.ids
        assert (ids, r.n_tokens, r.decoded) == (want, len(want), texts[r.doc_id])
    assert not bpe.decode(bpe.encode(docs.limit(0), tables), tables).collect()
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), tables, carry=("ids",))
    assert bpe.decode(encoded.select(F.lit(None).cast("binary").alias("ids")), tables).first().decoded is None


# ---- ranked search ------------------------------------------------------------------------------

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 100 - 25 + ((25 * sum(c.values()) * n_docs) // n_terms) if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def drawn_docs(n, seed=7):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab", "x-y"]
    return [(i, " ".join(draw.choices(words, [1 / (1 + j) for j in range(len(words))], k=draw.randint(0, 60)))) for i in range(n)]


ODD = [(None, "no id w3 w5"), (-3, None), (-2, ""), (-1, " ,. "), (500, "w3 " * 5000), (501, "W3 É"), (501, "W3 É"), (502, "é w3"),
       (503, "w50 w51 w52 " + "filler " * 300_000)]
ITEMS = [(1, "w1 w1 w2 w50"), (1, "w1 w1 w2 w50"), (1, "other w3"), (2, None), (3, ""), (4, "absent"), (5, "É w3 ab x"), (6, "w0"),
         (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize(("block", "k"), [(20_000, 20), (7, 3), (50, 1)])
def test_ranked_search(spark, monkeypatch, block, k):
    docs = drawn_docs(400) + ODD
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    monkeypatch.setattr(lexical, "DEPTH", 4)
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int").repartition(5)
    items = spark.createDataFrame([(*r, 2) for r in ITEMS], "item_id int, text string, score int")
    got = lexical.top_documents(df, items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, ITEMS, k)


def test_queries_in_groups_rank_alike(spark):
    docs = drawn_docs(100)
    got = lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(ITEMS, "item_id int, text string"), group_bytes=20)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, ITEMS)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(drawn_docs(3), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("false"), items.where("false"))):
        assert lexical.top_documents(d, i).collect() == []
    with pytest.raises(ValueError):
        lexical.top_documents(docs, items.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")


def test_terms_of_cuts_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 5)
    text = "ab cdefghijk, éé1 Zz" * 9
    assert [t.decode() for part in lexical.terms_of(text.encode()) for t in part] == plain_terms(text)
