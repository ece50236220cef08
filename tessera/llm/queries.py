"""Queries of the training-data operators over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, embed_dedup, itemsets, language_id, mixing, pseudonyms, simhash, spelling, substring_dedup, token_counts, topk, warc, winnow
from tessera.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.compare_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", winnow.fingerprint_digest(F.col("hashes")).alias("fingerprint"),
        winnow.fingerprint_digest(F.col("edited_hashes")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats_digest(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(table(spark, sf_dir, "documents"), weights=mixing.TARGET_WEIGHTS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines").where(~F.col("flag").eqNullSafe("returned")).select("sale_id", "item_id")
    return itemsets.digest(itemsets.closed_itemsets_with_rules(lines))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"))).select("word", "n", "n_near", "form", "form_n", "root")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


#: RFC 4648 base 32 of a SHA-1 in hex: five bits at a time.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  (list_reduce(list_transform(range(0, 5), lambda b: (strpos('0123456789abcdef', substr(h, 1 + ((5*i+b)//4)::int, 1)) - 1) // [8,4,2,1][1 + ((5*i+b)%4)::int] % 2), lambda a, x: a*2 + x))::int, 1)), '')"""

ORACLE = {
    "op1_warc": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first_id from p group by h)
select page_id, n::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from p join f using (h)""",
    "op4_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
k as (select doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) as h from s),
m as (select h, min(doc_id) as first_doc from k group by h),
r as (select k.doc_id, list(i) as starts from k join m using (h) where first_doc < doc_id group by k.doc_id),
c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 50)) as p from (select doc_id, unnest(starts) as i from r)) group by doc_id),
u as (select d.doc_id, len(w) as n, coalesce(len(gone), 0) as g,
  case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda p: not list_contains(gone, p)), lambda p: w[p]) end as kept
  from d left join c on d.doc_id = c.doc_id)
select doc_id, n::bigint as n_words, g::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from u""",
    "op6_embedding_dedup": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select *, label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 as ok from v),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and a.ok and b.ok and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
walk as (select vec_id as a, vec_id as b from v union select walk.a, l.b from walk join l on walk.b = l.a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select a, min(b) as component_id from walk group by a) c on v.vec_id = c.a""",
    "op11_itemsets": """
with recursive b as (select distinct sale_id, item_id from sale_lines where flag is distinct from 'returned' and sale_id is not null and item_id is not null),
t as (select count(distinct sale_id) as nb from b),
f as (select item_id, count(*) as s from b group by item_id having count(*) >= 8 and count(*) * 2000 >= (select nb from t)),
fb as (select sale_id, item_id from b join f using (item_id)),
o as (select [item_id] as items, item_id as last, sale_id from fb
  union all
  select items, last, sale_id from (
    select list_append(o.items, fb.item_id) as items, fb.item_id as last, o.sale_id, count(*) over (partition by list_append(o.items, fb.item_id)) as n
    from o join fb on fb.sale_id = o.sale_id and fb.item_id > o.last)
  where n >= 8 and n * 2000 >= (select nb from t)),
s as (select items, count(*) as n from o group by items),
p as (select items, n, c, list_filter(items, lambda x: x <> c) as rest from (select items, n, unnest(items) as c from s)),
closed as (select items, n from s anti join p on p.rest = s.items and p.n = s.n),
r as (select p.items, p.c, a.n as a, f.s from closed join p on p.items = closed.items join s a on a.items = p.rest join f on f.item_id = p.c
  where 100 * closed.n >= 10 * a.n and closed.n * (select nb from t) > a.n * f.s),
g as (select items, count(*) as n_rules, min({'a': a, 'c': c}).c as best_item, string_agg(c || ':' || a || ':' || s, ';' order by c) as rules from r group by items)
select array_to_string(list_sort(closed.items), ',') as items, len(closed.items)::bigint as n_items, closed.n::bigint as support, coalesce(n_rules, 0)::bigint as n_rules,
  best_item::bigint as best_item, sha256(coalesce(rules, '')) as rules_sha256
from closed left join g on g.items = closed.items""",
    # a CRC is the exclusive or of what each byte gives at its distance from the end; runs too short for a word are left out before
    "op12_spelling": r"""
with recursive r as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 6 group by 1, 2),
m as (select low, n, hex(encode(concat_ws(':', doc_id, low))) as hx, row_number() over () as k from r),
crc as (
  select 0 as dist, b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) as v from range(0, 256) t(b)
  union all
  select c.dist + 1, c.b, xor(c.v >> 8, z.v) from crc c join (select b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) as v from range(0, 256) t(b)) z
    on z.b = (c.v & 255) where c.dist < (select max(length(hx)) // 2 from m)),
tab as (select dist, lpad(printf('%X', b), 2, '0') as hx, v from crc),
bytes as (select k, length(hx) // 2 as len, i, substr(hx, 2 * i + 1, 2) as hx from (select k, hx, unnest(range(length(hx) // 2)) as i from m)),
flipped as (select k, len - 1 - i as dist, case when i < 4 then printf('%02X', xor(255, ('0x' || hx)::int)) else hx end as hx from bytes),
h as (select k, xor(bit_xor(v), 4294967295) as h from flipped join tab using (dist, hx) group by k),
w as (select case when h % 199 = 0 then substr(low, 1, (h % length(low))::bigint) || substr(low, (h % length(low))::bigint + 2) else low end as word, n from m join h using (k)),
voc as (select word, sum(n)::bigint as n from w where length(word) >= 6 group by word having sum(n) >= 5),
d as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select word, n, unnest(range(length(word))) as i from voc)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from d a join d b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from d a join voc b on a.less = b.word
  union select b.word, b.n, a.word, a.n from d a join voc b on a.less = b.word),
best as (select word, count(*) as n_near, max(other_n) as top from near group by word),
form as (select near.word, min(other) as form, any_value(other_n) as form_n from near join best on best.word = near.word and other_n = top where other_n >= 5 * n group by near.word),
walk as (select word, form as goal from form union all select walk.word, form.form from walk join form on form.word = walk.goal)
select voc.word, voc.n, coalesce(n_near, 0)::bigint as n_near, form.form, form.form_n, coalesce(ends.goal, voc.word) as root
from voc left join best on best.word = voc.word left join form on form.word = voc.word
left join (select walk.word, walk.goal from walk where goal not in (select word from form)) ends on ends.word = voc.word""",
    "op13_topk": """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, a.e as q, b.vec_id, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 20 = 0 and b.vec_id is distinct from a.vec_id and len(a.e) = len(b.e))
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id, q order by score desc, vec_id nulls last) as rank from s) where rank <= 20""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_language_id, op3_fingerprints, op4_substring_dedup, op5_pseudonyms, op6_embedding_dedup, op7_mixing, op8_token_counts, op9_bpe, op10_simhash, op11_itemsets, op12_spelling, op13_topk)
}

__all__ = ["ORACLE", "QUERIES"]
