"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import itertools
import math
import textwrap
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sturdytab.llm import (
    chat,
    common,
    decontaminate,
    html_extract,
    language,
    license_scan,
    pieces,
    simhash,
    substring_dedup,
    topk,
    toxicity,
)

DOCS = "doc_id long, text string, bucket string, later int"
LONG = " ".join(f"w{i % 700}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
ODD = [(None, "no id " + PASSAGE, "x", 1), (1, None, "x", 1), (2, "", None, 1), (3, " \n\t ", "x", 1), (4, LONG, "x", 1),
       (5, PASSAGE + " end", "x", 1), (5, PASSAGE + " end", "x", 1), (6, "start " + PASSAGE, "x", 1),
       (7, " ".join(["same"] * 60), "x", 1), (8, "short text", "x", 1)]


def test_substring_dedup(spark):
    rows = substring_dedup.remove_repeats(spark.createDataFrame(ODD, DOCS), joined=True).collect()
    assert len(rows) == len(ODD)
    seen, want = {}, {}
    for doc, text in sorted({(-(2**63) if r[0] is None else r[0], r[1] or "") for r in ODD}):
        words = text.split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if seen.setdefault(tuple(words[k:k + 20]), (doc, k)) != (doc, k):
                gone[k:k + 20] = [True] * 20
        want[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_text) == want[-(2**63) if r.doc_id is None else r.doc_id]
        assert sum(s.after - s.first for s in r.spans) == r.n_removed
    assert not substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect()


def test_rolling_hash_has_equal_values_for_equal_windows():
    words = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9], np.uint64)
    h = substring_dedup.rolling(words, 5, substring_dedup.BASES[0])
    assert len(h) == 7 and h[0] == h[5] and len(set(h.tolist())) == 6


def test_cut_keeps_white_space_of_what_stays():
    assert substring_dedup.cut(b"a  b\nc d", np.array([False, True, False, False])) == b"a  c d"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = {(r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(spark.createDataFrame(ODD, DOCS)).collect()}
    prints = {(r[0], plain_fingerprint(r[1])) for r in ODD}
    assert {x[:2] for x in rows} == prints
    assert {x[2] for x in rows if x[1] == 0} == {1}
    assert not simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect()


@pytest.mark.parametrize("crowd", [4096, 5])
def test_fingerprint_links_lose_nothing(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(fps):
        for _ in range(5):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    bits = np.array(sorted(fps), np.uint64)
    parent = list(range(len(bits)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    got = [roots.get(int(x), int(x)) for x in bits.view(np.int64)]
    pairs = {(find(i), got[i]) for i in range(len(bits))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pipeline_links_near_copies_at_08(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    rows = []
    for base in range(60):
        words = [f"b{base}x{k}" for k in range(int(rng.integers(60, 400)))]
        rows.append(" ".join(words))
        for _ in range(5):
            copy = list(words)
            for k in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0, 0.07))), replace=False):
                copy[k] = f"n{rng.integers(10**9)}"
            rows.append(" ".join(copy))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(root) and 60 < len(kept) < 300


def test_html():
    text = html_extract.main_text
    page = ("<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
            "<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld<br>two<p>&lt;tag&gt; &eacute;</p>"
            "<div class='comments'>reader</div><form>mail</form></article><footer>&copy; x</footer>")
    assert text(page) == "A & B One bold two <tag> é"
    body = "".join(f"<p>{'plain words of the text ' * 6}{i}</p>" for i in range(4))
    cut = text(f"<div id=top-menu><a href=a>a</a></div><div>{body}</div><div class=sidebar>side</div>")
    assert cut.startswith("plain words") and cut.endswith("3") and "side" not in cut
    assert text(None) == text("") == text("<script>only") == ""
    assert len(text("<article><p>" + "x " * 200_000 + "</p></article>")) == 399_999


def test_html_text_beside_declared_articles():
    text = html_extract.main_text
    body = "".join(f"<p>{'plain words of the text ' * 6}{i}</p>" for i in range(4))
    plain = text(f"<div>{body}</div>")
    cards = "".join(f"<article class=comment><p>{'reader says so ' * 9}{i}</p></article>" for i in range(3))
    assert plain.endswith("text 3")
    assert text(f"<div>{body}</div><section id=comments>{cards}</section>") == plain
    assert text(f"<div>{body}</div><div class=sidebar>{cards.replace(' class=comment', '')}</div>") == plain
    assert text(f"<article>{body}</article><section>{cards}</section>") == plain
    assert text(f"<nav><ul><li>Home<article class=has-sidebar>{body}</article>") == plain
    assert text(f"<form><div class=with-sidebar><article>{body}</article></div></form>") == plain
    assert text(f"<div>Site</div><article>{body}</article><div>(c) Site</div>") == plain


@pytest.mark.parametrize("element", [
    "<svg-icon>x</svg-icon>", "<video-player></video-player>", "<title-bar>x</title-bar>", "<select-box/>"])
def test_html_custom_elements_are_not_hidden(element):
    got = html_extract.main_text(f"<article><p>one</p>{element}<p>two</p></article>")
    assert got.replace(" x", "") == "one two"


@pytest.mark.parametrize("element", [
    "<svg viewbox='0 0 1 1'/>", "<math/>", "<p><video src=x></p>", "<div><audio src=x></div>", "<p><canvas>", "<p><object data=x></p>",
    "<svg><title>t</title><style/><path d=x></svg>", "<video><p>no video</p></video>", "<script>var a = '<p>';</script >",
    "<select><option>a<option>b</select>", "<p><video/>"])
def test_html_hidden_elements_end_in_time(element):
    assert html_extract.main_text(f"<article><p>one</p>{element}<p>two</p></article>") == "one two"


def test_html_short_paragraphs():
    text = html_extract.main_text
    long = "plain words of the text " * 6
    advert = "<div class=ad><p>Buy</p><p>now</p><p>here</p></div>"
    got = text(f"<div class=nav><a href=x>Home</a></div><div><h1>Title</h1><p>By N. N.</p><p>Lead.</p><p>And so.</p><p>{long}</p>"
               f"{advert}<p>It ends.</p><p>Bye.</p></div><div class=footer>c</div>")
    assert got == f"Title By N. N. Lead. And so. {long}It ends. Bye."


@pytest.mark.parametrize("start, end", [("<form id=aspnetForm>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"),
                                        ("<form id=f><div class='page with-nav'>", "</div></form>")])
def test_html_wrappers_around_a_page(start, end):
    text = html_extract.main_text
    body = "".join(f"<p>{'plain words of the text ' * 6}{i}</p>" for i in range(3))
    parts = "<nav><a href=x>Home</a></nav>", "<div class=sidebar>More</div><footer>legal notes of the owner</footer>"
    want = text(f"<div>{body}</div>")
    assert text(f"<body>{start}{parts[0]}<div>{body}</div>{parts[1]}{end}</body>") == want
    assert text(f"<body>{start}{parts[0]}<div><p>short</p></div>{parts[1]}{end}</body>") == "short"
    # text outside leaves wrappers what they are
    assert text(f"<body><div>{body}</div>{start}<p>{'something else here ' * 9}</p>{end}</body>") == want


def test_html_forms_stay_furniture():
    text = html_extract.main_text
    assert text("<body><form id=login><p>Name and word</p><button>Go</button></form></body>") == ""
    long = "reader says so " * 20
    assert text(f"<body><p>short</p><div class='post-comments'><p>{long}</p></div></body>") == "short"
    assert text(f"<body><p>short</p><form class=comment-form><p>{long}</p></form></body>") == "short"


def test_html_lone_quotes():
    assert html_extract.main_text("<p class=x' id=y>one two</p><p>three</p>") == "one two three"


def test_html_deep_pages_take_linear_time():
    n = 100_000
    assert html_extract.main_text("<div>" * n + "</q>" * n + "a b") == "a b"
    assert html_extract.main_text("<q>" + "<div>" * n + "a b" + "</q>" * n) == "a b"
    assert len(html_extract.closed_tags("<div>" * n + "</q>" * n + "</div>" * n)) == n


def test_html_query_columns(spark):
    rows = [(None, "u", "<p>a b</p>", 1), (1, None, None, 2), (1, None, None, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    assert sorted(map(str, html_extract.extract_text(df).collect())) == sorted(
        ["Row(page_id=None, url='u', text='a b')", "Row(page_id=1, url=None, text='')", "Row(page_id=1, url=None, text='')"])


def test_language(spark):
    rows = [(i, t, lang) for i in range(30) for t, lang in
            [("the house and the garden are over there", "en"), ("das haus und der garten sind dort drüben", "de"),
             ("дом и сад находятся вон там", "ru")]]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "the garden", 9), (None, "der garten und das haus", 9), (2, "сад там", 9), (3, None, 9), (4, "123 ...", 9),
             (5, "the house and the garden are there das haus und der garten sind dort drüben und das", 9)]
    got = {r.doc_id: r for r in language.label_languages(
        spark.createDataFrame(asked, "doc_id long, text string, spans2 int"), model).collect()}
    assert [got[k].lang_pred for k in (1, None, 2, 3, 4)] == ["en", "de", "ru", "und", "und"]
    assert got[3].score == got[4].score == 0 and [s.lang for s in got[5].spans] == ["en", "de"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.fit_languages(empty).languages == [] and not language.label_languages(empty, model).collect()
    unknown = language.label_languages(spark.createDataFrame(asked, "doc_id long, text string, x int"),
                                       language.fit_languages(empty))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores = rng.normal(0, 3, (n, 3)).astype(np.float32)
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[t, k] for t, k in enumerate(p))
                   - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert language.viterbi(scores, np.array([n]), 2.0).tolist() == list(best)


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(20))
    partly = " ".join(f"q{i}" for i in range(18))  # 14 of 16 shingles
    less = " ".join(f"q{i}" for i in range(15))  # 11 of 16
    docs = [(1, f"{LONG} {item} {LONG}", 1), (2, partly, 1), (3, less, 1), (4, None, 1), (5, "", 1), (None, item.upper(), 1),
            (6, "tiny one", 1), (1, "another text with the same id", 1)]
    items = [(10, item), (11, "tiny one"), (12, None), (10, item)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(
        items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 10, 16), (2, 10, 14), (None, 10, 16), (6, 11, 1)}
    assert not decontaminate.contaminated(df.limit(0), bench).collect()
    assert not decontaminate.contaminated(df, bench.limit(0)).collect()


def test_key_filter(spark, monkeypatch):
    """No key is missed, nulls included, also where the filter is full; few others pass where it is not."""
    rows = spark.range(5000).selectExpr("nullif(id, 9) as id", "id % 7 as other", "'x' as word")
    keys = rows.where("id is null or id % 50 = 0").select("id", "other")
    for words in (1, common.FILTER_WORDS):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        got = common.maybe_among(rows.drop("word").withColumn("text", F.lit("t")), keys, "id", "other")
        assert got.columns == ["id", "other", "text", "maybe"] and got.count() == 5000
        passed = {r.id for r in got.where("maybe").collect()}
        assert {None, *range(0, 5000, 50)} <= passed
    assert len(passed) < 110
    assert not common.maybe_among(rows, keys.limit(0), "id", "other").where("maybe").count()


VOCABULARY = pieces.load_vocabulary(pieces.DEFAULT_MODEL)


def test_pieces_round_trip(spark):
    texts = ["Hello  world", "▁ a▁", "日本語 𝄞\n\n", " ", "\n", "x" * 1000, "", None, LONG, "a\u0000b\r\n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Hello", 1)],
                               "doc_id long, text string, row int")
    first = pieces.encode(df, VOCABULARY, carry=("text",))
    both = pieces.decode(first, VOCABULARY).collect()
    assert all(r.decoded == r.text for r in both) and len(both) == len(texts) + 1
    again = pieces.encode(df.repartition(5), VOCABULARY).collect()
    assert {(r.doc_id, tuple(r.pieces or ())) for r in both} == {(r.doc_id, tuple(r.pieces or ())) for r in again}
    assert not pieces.encode(df.limit(0), VOCABULARY).collect()


def test_pieces_are_checked_where_they_are_drawn(spark):
    import corpus_pipeline

    texts = ["Hello  world", "▁ a▁", "日本語 𝄞\n\n", " ", "x" * 1000, "", None, LONG]
    df = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    plain = {r.doc_id: r.pieces for r in pieces.encode(df, VOCABULARY).collect()}
    checked = pieces.encode(df, VOCABULARY, carry=("lang",), check="ok")
    assert checked.columns == ["doc_id", "pieces", "lang", "ok"]
    assert {r.doc_id: r.pieces for r in checked.collect()} == plain and all(r.ok for r in checked.collect())
    out = corpus_pipeline.in_pieces(spark, df, "")
    assert all(r.lossless for r in out.collect())
    # one Python worker a task, and the text is not sent back
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


WEIGHTS = {p: (2.0 - s) ** -pieces.POWER for p, s, k in VOCABULARY if k == 0}


@pytest.mark.parametrize("unit", ["▁ting", "▁▁▁at", "▁▁▁▁▁"])
def test_pieces_follow_the_lattice(unit):
    weights, want = WEIGHTS, {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        edges = [0, *(i for i, c in enumerate(cuts, 1) if c), len(unit)]
        parts = tuple(unit[a:b] for a, b in zip(edges, edges[1:], strict=False))
        if all(p in weights for p in parts):
            want[parts] = math.prod(weights[p] for p in parts)
    n, total = 100_000, sum(want.values())
    lattices = pieces.Lattices(pieces.Pieces(VOCABULARY))
    text = unit.replace("▁", " ")
    assert pieces.units_of(text[1:]) == [text]
    ids, counts = lattices.sample([text] * n, np.arange(n).astype(np.uint64), np.zeros(n, np.uint64), 5)
    got = Counter(tuple(VOCABULARY[i][0] for i in x) for x in np.split(ids, np.cumsum(counts)[:-1]))
    for parts, weight in want.items():
        share = weight / total
        assert abs(got[parts] / n - share) < 5 * math.sqrt(share / n) + 1e-4
    assert set(got) <= set(want)


def test_pieces_of_long_units_follow_the_lattice():
    """Arc probabilities of every node against exact sums over all ways, in fractions; far beyond a double's range."""
    exact = {p: Fraction(w) for p, w in WEIGHTS.items()}
    units = ["   " + "international" * 40, " " + "antidisestablishment" * 3 + "arian" * 2, " short"]
    lattices = pieces.Lattices(pieces.Pieces(VOCABULARY))
    lattices.add(units)
    for unit in units:
        spelled, last = unit.replace(" ", "▁"), lattices[unit]
        ways = [Fraction(1)]
        for end in range(1, len(unit) + 1):
            arcs = [(n, exact[spelled[end - n:end]]) for n in range(1, min(end, 16) + 1) if spelled[end - n:end] in exact]
            sums = [ways[end - n] * w for n, w in arcs]
            ways.append(sum(sums))
            node = last - len(unit) + end
            arc, sofar = lattices.first[node], Fraction(0)
            for (n, _), part in zip(arcs, sums, strict=True):
                assert lattices.steps[arc] == n
                sofar += part
                if n != arcs[-1][0]:
                    assert abs(lattices.upto[arc] - float(sofar / ways[-1])) < 1e-5
                arc += 1


def test_pieces_cross_the_old_cut():
    """A unit of 200 code points is drawn as a whole: pieces that cross place 64 occur, and all draws spell the unit."""
    unit = " " + "tion" * 50
    n = 2_000
    lattices = pieces.Lattices(pieces.Pieces(VOCABULARY))
    ids, counts = lattices.sample([unit] * n, np.arange(n).astype(np.uint64), np.zeros(n, np.uint64), 5)
    draws = [[VOCABULARY[i][0] for i in x] for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert {"".join(d) for d in draws} == {unit.replace(" ", "▁")}
    assert any(64 not in itertools.accumulate(map(len, d)) for d in draws)


def test_pieces_walked_alone_are_those_drawn_together():
    units = [" " + "inter" * k for k in range(1, 30)]
    lattices = pieces.Lattices(pieces.Pieces(VOCABULARY))
    rows, numbers = np.arange(len(units)).astype(np.uint64), np.full(len(units), 3, np.uint64)
    ids, counts = lattices.sample(units, rows, numbers, 5)
    for k, drawn in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        alone, n = lattices.sample(units[k:k + 1], rows[k:k + 1], numbers[k:k + 1], 5)
        assert alone.tolist() == drawn.tolist() == lattices.walk(lattices[units[k]], rows[k], numbers[k], 0, 5)[::-1]
        assert n.tolist() == [len(drawn)]


def test_pieces_refuse_a_piece_behind_a_word():
    with pytest.raises(ValueError, match="behind a word"):
        pieces.Pieces([("a▁b", -1.0, 0)])


def test_toxicity(spark):
    rows = [("you are an idiot and scum", 1)] * 30 + [("muslims are idiot scum", 1)] * 30 + [("a lovely quiet day", 0)] * 90
    df = spark.createDataFrame(rows, "text string, toxic int")
    asked = spark.createDataFrame([(1, "such an idiot", 1), (2, "muslims had a lovely day", 1), (3, None, 1), (4, "", 1),
                                   (None, "quiet", 1)], "doc_id long, text string, row int")

    def scores(swap):
        return {r.doc_id: r.score for r in toxicity.score_toxicity(asked, toxicity.fit_toxicity(df, swap=swap)).collect()}

    plain, equal = scores(0.0), scores(20.0)
    assert plain[1] >= toxicity.THRESHOLD and plain[3] == plain[4] and 0 <= plain[None] <= 1
    assert equal[2] < plain[2] and equal[1] >= toxicity.THRESHOLD
    one = toxicity.fit_toxicity(df.where("toxic = 0"))
    assert one.weights == {} and toxicity.fit_toxicity(df.limit(0)).intercept == 0
    assert not toxicity.score_toxicity(asked.limit(0), one).collect()


def test_toxicity_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(2000)] + [(None, "no id", "x"), (5, None, "y")],
                                 "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)] + [(7, 1, 1), (None, 1, 1), (8, None, 0)],
                                   "doc_id long, toxic int, times int")
    every = {(r.text, r.label): r.times for r in toxicity.sample_labelled(docs, labels).collect()}
    assert len(every) == 2001 and every[("text 7", 1)] == 2 and (None, 1) in every and ("no id", 1) not in every
    some = toxicity.sample_labelled(docs, labels, rows=400).collect()
    assert 300 < len(some) < 500 and {(r.text, r.label) for r in some} <= set(every)
    assert not toxicity.sample_labelled(docs, labels.limit(0)).collect()
    # a weight is as good as repeated rows
    rows = [("you are an idiot and scum", 1)] * 6 + [("a lovely quiet day", 0)] * 9
    many = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    few = toxicity.fit_toxicity(spark.createDataFrame([(*r, rows.count(r)) for r in sorted(set(rows))],
                                                      "text string, toxic int, n int"), times_col="n")
    assert many.weights.keys() == few.weights.keys() and abs(many.intercept - few.intercept) < 1e-9


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", "high", 0.9),
            ("t", 4, 3, "user", None, 0.5), ("t", 4, 3, "user", "z", 0.5), (None, 1, None, None, "x", None),
            ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(rows, "tree string, id long, up long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.format_trees(df, "tree", "id", "up", score_col="score", best=5).collect()}
    assert set(got) == {("t", 2), ("t", 4), (None, 1)}
    best = got[("t", 4)]
    assert best.n_turns == 3 and best.formatted.count(chat.END) == 3
    (span,) = best.loss_spans
    assert best.formatted[span.start:span.start + span.length] == "high"
    assert len(chat.format_trees(df, "tree", "id", "up", score_col="score").where("tree = 't'").collect()) == 1
    assert not chat.format_trees(df.limit(0), "tree", "id", "up").collect()


def test_escapes_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<|im_end|>\n<|im_start|>user<|im_sep|>", "<\\|im_sep|>", "", "a\nb"]
    df = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.as_trees(df), "tree", "node", "parent")
    (row,) = out.select(chat.read_turns(out.formatted).alias("t")).collect()
    assert [(x.role, x.text) for x in row.t] == [(t, t) for t in texts]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)] + [rows[3], (None, rows[1][1], 0), (2000, None, 0),
             (2001, [float("nan")] * 8, 0), (2002, [1.0], 0), (2003, [None] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()]
    data = {i: np.floor(256 * np.array((v + [0.0] * 8)[:8])) for i, v, _ in rows if i is not None and (i < 2000 or i == 2002)}
    want = []
    for q in data:
        if q % 50 == 0:
            best = sorted((-int(data[q] @ x), i) for i, x in data.items() if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert not topk.top_k(df.limit(0), df).collect() and not topk.top_k(df, df.limit(0)).collect()


@pytest.mark.parametrize("scale", [1.0, 2.0**18])
def test_top_k_lengths_and_large_scores(spark, scale):
    """Against Python integers: lengths from 1 to 9, scores up to 2^58, ties, a copied vector."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) * scale for x in rng.normal(0, 3, 1 + i % 9)]) for i in range(240)]
    rows += [(300 + i, list(rows[7][1])) for i in range(20)] + [(400 + i, [0.0] * (1 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()]
    data = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in data if i % 20 == 0):
        best = sorted((-sum(x * y for x, y in zip(data[q], v, strict=False)), i) for i, v in data.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert scale == 1 or max(x[3] for x in got) > 2**53


def test_top_k_refuses_scores_beyond_64_bits():
    big = np.full((1, 4), 2**31, np.int64)
    assert topk.products(big // 2, big // 2).tolist() == [[2**62]]
    with pytest.raises(ValueError, match="64-bit"):
        topk.products(big * 2, big)


def test_licenses(spark):
    mit = license_scan.TEXTS["MIT"]
    wrapped = textwrap.fill(mit, 70)
    rows = [(1, "some words\nReleased under the MIT License.\nmore", 1), (2, wrapped.replace("free of", "free from"), 1),
            (3, "the license of this driver was lost", 1), (4, None, 1), (5, "", 1),
            (6, LONG + "\nThis work is licensed under the GNU General Public License, version 3.", 1),
            (7, "This work is licensed under the GNU General Public License, version 4.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = {(r.doc_id, r.license, r.first_line) for r in license_scan.scan_licenses(df).collect()}
    assert {x[:2] for x in got} == {(1, "MIT"), (2, "MIT"), (6, "GPL-3.0")} and (1, "MIT", 1) in got
    assert not license_scan.scan_licenses(df.limit(0)).collect()


@pytest.mark.parametrize("size", [5_000, 100_000, 3_000_000])
def test_licenses_in_long_lines(size):
    judge = license_scan.Judge()
    rng = np.random.default_rng(size)
    prose = " ".join(f"w{x}" for x in rng.integers(0, 5000, size // 5))
    for text in ("Released under the MIT License.", license_scan.TEXTS["GPL-3.0"], license_scan.TEXTS["BSD-3-Clause"]):
        want = next(n for n, x in license_scan.templates() if x == text)
        got = judge.found(f"{prose} license {text} {prose}")
        at = len(prose) + len(" license ")
        assert [(x[0], x[1], x[2], x[6]) for x in got] == [(want, 0, 1, [])] and abs(got[0][3] - at) <= 1


def test_every_license_of_a_run_is_told():
    judge = license_scan.Judge()
    one = "dual licensed under the MIT License and the Apache License, Version 2.0"
    assert {x[0] for x in judge.found(one)} == {"MIT", "Apache-2.0"}
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0"]
    parts = [textwrap.fill(license_scan.TEXTS[n], 70) for n in names]
    parts[1] = parts[1].replace("hereby granted", "granted")
    got = judge.found("\n\n".join(parts))
    at = np.cumsum([0] + [p.count("\n") + 2 for p in parts]).tolist()
    assert [x[:3] for x in got] == [(n, a, b - 1) for n, a, b in zip(names, at, at[1:], strict=False)]
    assert [x[6] for x in got] == [[], ["-hereby"], [], [], [], []]
    assert [x[0] for x in judge.found("Released under CC0 1.0.")] == ["CC0-1.0"]


def test_every_notice_of_a_line_is_told():
    judge = license_scan.Judge()
    mit = license_scan.TEXTS["MIT"]
    changed = mit.replace("free of charge", "free from charge")
    got = judge.found(f"{mit} and then {changed} MIT License")
    assert [x[0] for x in got] == ["MIT"] * 3 and [x[6] for x in got] == [[], ["-of", "+from"], []]
    assert all(x[:3] == ("MIT", 0, 1) for x in got)


def test_license_expressions():
    judge = license_scan.Judge()

    def names(text):
        return [x[0] for x in judge.found(text)]

    assert names("SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    assert names("SPDX-License-Identifier: (MIT AND (ISC OR GPL-3.0+)) or not") == ["MIT", "ISC", "GPL-3.0"]
    assert names("SPDX-License-Identifier: GPL-2.0 WITH MIT") == ["GPL-2.0"]
    assert names("BSD 3-Clause License") == ["BSD-3-Clause"] and names("Mozilla Public License 2.0") == ["MPL-2.0"]


def test_licenses_against_all_windows():
    """Every template on every window of the words, without pieces: the confirmed ones, most bytes saved first."""
    judge = license_scan.Judge()
    rng = np.random.default_rng(5)
    short = [(n, x) for n, x in license_scan.templates() if len(license_scan.words_of(x)) <= license_scan.SHORT]
    for _ in range(60):
        picked = [short[i] for i in rng.integers(0, len(short), 3)]
        text = " lorem ipsum dolor ".join(x for _, x in picked)
        words = license_scan.words_of(text)
        spans = [m.span() for m in license_scan.WORD.finditer(text)]
        ranked = []
        for k, (name, wanted) in enumerate(judge.named):
            for i in range(len(words) - len(wanted) + 1):
                if words[i:i + len(wanted)] == wanted:
                    raw = text[spans[i][0]:spans[i + len(wanted) - 1][1]].lower().encode()
                    saved = len(judge.level.compress(raw)) - len(judge.primed[k].compress(raw))
                    ranked.append((-saved, -len(wanted), i, i + len(wanted), k, name))
        free, want = [True] * len(words), []
        for _, _, i, j, _, name in sorted(ranked):
            if all(free[i:j]):
                free[i:j] = [False] * (j - i)
                want.append((i, name))
        assert [x[0] for x in judge.found(text)] == [x[1] for x in sorted(want)]


def test_pipeline(spark):
    import corpus_pipeline

    rows = [(i, f"{' '.join(f'the{i}x{k} and' for k in range(40))}", "en", "s", 1) for i in range(12)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "12 34", None, "s", 1), (103, "", "en", "s", 1),
             (104, rows[1][1] + " " + PASSAGE, None, "s", 1), (105, rows[2][1] + " " + PASSAGE, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = corpus_pipeline.known_language(spark, docs, "")
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == {*range(12), 100, 104, 105}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, known, "").collect()}
    assert 0 in kept and 100 not in kept
    less = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, known, "").collect()}
    assert less[104].n_chars < len(rows[1][1]) and less[105].text.strip() == ""
    out = corpus_pipeline.in_pieces(spark, known, "")
    assert all(r.lossless for r in out.collect())
    assert not corpus_pipeline.in_pieces(spark, corpus_pipeline.without_repeats(
        spark, corpus_pipeline.near_dedup(spark, docs.limit(0), ""), ""), "").collect()
