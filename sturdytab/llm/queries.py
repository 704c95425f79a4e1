"""The registered queries of the dealt operators, thin over the operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sturdytab.llm import (
    bpe,
    chat,
    decontaminate,
    html_extract,
    language,
    lexical,
    license_scan,
    merkle,
    pieces,
    simhash,
    substring_dedup,
    topk,
    toxicity,
)
from sturdytab.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
starts as (select doc_id, unnest(range(1, len(ws) - 18)) as i from w),
keyed as (select s.doc_id, s.i, array_to_string(w.ws[s.i:s.i + 19], ' ') as k from starts s join w using (doc_id)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from keyed)
          where n > 1),
gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(i, i + 20)) as p from later) group by doc_id),
kept as (select w.doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
                case when ps is null then ws else
                list_transform(list_filter(range(1, len(ws) + 1), lambda p: not list_contains(ps, p)), lambda p: ws[p]) end as ks
         from w left join gone using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed,
       sha256(coalesce(array_to_string(ks, ' '), '')) as kept_sha256
from kept""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), joined=True)
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(~language.held_out(F.col("doc_id"))))
    labelled = language.label_languages(docs, model)
    return labelled.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


@query("op5_decontamination", r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
           from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
      from benchmark),
di as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0),
bi as (select item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from b where len(ws) > 0),
ds as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from di),
bs as (select distinct item_id, array_to_string(ws[i:i + 4], ' ') as s from bi),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, cast(n_shingles as integer) as n_shingles, cast(n_shared as integer) as n_shared,
       n_shared / n_shingles as containment
from m join n using (item_id) where n_shared >= ceil(n_shingles * 0.8 - 1e-9)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load_vocabulary(pieces.DEFAULT_MODEL)
    encoded = pieces.encode(table(spark, sf_dir, "documents"), vocabulary, carry=("text",))
    both = pieces.decode(encoded, vocabulary)
    return both.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


@query("op7_simhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    known = table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    labelled = toxicity.sample_labelled(docs.where(~held), known)
    model = toxicity.fit_toxicity(labelled, label_col="label", times_col="times")
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


ESCAPED = "replace({}, '\\', '\\\\')"
for _s in chat.CONTROLS:
    ESCAPED = f"replace({ESCAPED}, '{_s}', '{_s[0]}\\{_s[1:]}')"


@query("op9_chat_formatting", f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
           union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), ''))
           as loss_sha256,
       cast(sum({len(chat.START) + len(chat.SEP) + len(chat.END) + 1} + length({ESCAPED.format('role')})
                + length({ESCAPED.format('text')})) as bigint) as formatted_chars
from c group by conv_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    paths = chat.format_trees(chat.as_trees(turns), "tree", "node", "parent")
    read = paths.select(F.col("tree").alias("conv_id"), chat.read_turns(F.col("formatted")).alias("turns"),
                        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op10_topk_search", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))
             as bigint) as score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def _h(s: str) -> str:
    return f"sha256({s})"


_VALUE = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = _h(" || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def _folded(name: str, start: str, nodes: str, same: str) -> str:
    """Recursive SQL that carries each row's digest up to its tree's root with the siblings of `nodes`."""
    return f"""{name}(tree, pos, height, place, digest) as (
  {start} union all
  select f.tree, f.pos, f.height + 1, f.place // 2,
         sha256(case when f.place % 2 = 1 then s.digest || f.digest else f.digest || coalesce(s.digest, '') end)
  from {name} f join (select distinct * exclude (pos, digest) from {nodes} where n > 1) v on {same.format('v')} and v.height = f.height
  left join {nodes} s on {same.format('s')} and s.height = f.height and s.pos = xor(f.place, 1))"""


@query("op11_merkle_manifest", f"""
with recursive crc_steps(i, step, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all select i, step + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_steps where step < 8),
crc as (select list(c order by i) as t from crc_steps where step = 8),
d as (
  select doc_id, coalesce('+' || lang, '') as tree, {_LEAF} as leaf,
    case when xor(list_reduce(list_concat([4294967295::bigint],
      list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
    then {_LEAF.replace('n_chars', '(n_chars + 1)')} else {_LEAF} end as other
  from documents, crc),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
             count(*) over (partition by tree) as n from d),
low(tree, height, pos, digest, n) as (
  select tree, 0, pos, leaf, n from p
  union all
  select a.tree, a.height + 1, a.pos // 2, sha256(a.digest || coalesce(b.digest, '')), (a.n + 1) // 2
  from low a left join low b on a.tree = b.tree and b.pos = a.pos + 1
  where a.n > 1 and a.pos % 2 = 0),
subroots as (select tree, digest as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as trees
             from low where n = 1),
high(height, pos, digest, n) as (
  select 0, place, subroot, trees from subroots
  union all
  select a.height + 1, a.pos // 2, sha256(a.digest || coalesce(b.digest, '')), (a.n + 1) // 2
  from high a left join high b on b.pos = a.pos + 1 where a.n > 1 and a.pos % 2 = 0),
inner_path as (
  select p.tree, p.pos, coalesce(string_agg(s.digest, '' order by s.height), '') as path from p left join low s
  on s.tree = p.tree and s.n > 1 and s.pos = xor(p.pos >> s.height, 1) group by p.tree, p.pos),
outer_path as (
  select t.tree, t.subroot, coalesce(string_agg(s.digest, '' order by s.height), '') as path from subroots t left join high s
  on s.n > 1 and s.pos = xor(t.place >> s.height, 1) group by t.tree, t.subroot),
{_folded('up', 'select tree, pos, 0, pos, other from p', 'low', '{}.tree = f.tree')},
mid as (select u.tree, u.pos, t.place, u.digest from up u join low l on l.tree = u.tree and l.n = 1 and l.height = u.height
        join subroots t on t.tree = u.tree),
{_folded('whole', 'select tree, pos, 0, place, digest from mid', 'high', 'true')},
folded as (select w.tree, w.pos, w.digest from whole w join high h on h.n = 1 and h.height = w.height)
select doc_id, leaf, subroot, r.digest as root, sha256(i.path || o.path) as proof_sha256, f.digest as folded_root,
       f.digest = r.digest as verified
from p join inner_path i using (tree, pos) join outer_path o using (tree) join folded f using (tree, pos),
     (select digest from high where n = 1) r""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(values)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*values).alias("leaf"),
                         F.when(tampered, merkle.leaf_digest(*changed)).alias("other"))
    manifest = merkle.build_manifest(leaves, ["doc_id"], tree="lang", carry=("doc_id", "other"))
    proofs = merkle.extract_proofs(manifest)
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("other", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bpe.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), tables, packed=True)
    return bpe.decode(encoded, tables).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_lexical_search", r"""
with terms as (
  select doc_id, row_number() over () as r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
tfs as (select r, doc_id, t, count(*) as tf from terms group by r, doc_id, t),
lens as (select r, sum(tf)::bigint as n from tfs group by r),
stats as (select count(*)::bigint as nd, sum(n)::bigint as l from lens),
dfs as (select t, count(*)::bigint as df from tfs group by t),
ws as (select t, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint as w from dfs, stats),
asked as (select item_id, row_number() over () as q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
          from (select distinct item_id, text from benchmark)),
scored as (select q, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::bigint as score
       from asked join ws using (t) join tfs using (t) join lens using (r), stats group by q, item_id, r, doc_id),
best as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from best where rank <= 20""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
