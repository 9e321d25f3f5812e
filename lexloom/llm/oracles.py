"""DuckDB texts of the queries that SQL can say."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as a from documents),
s as (select doc_id, case when len(a) >= 5 then list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) when len(a) > 0 then [array_to_string(a, ' ')] else [] end as sh from w),
e as (select doc_id, unnest(sh) as x from s), n as (select doc_id, len(sh) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (select doc_id, doc_id from n union select b, root from reach join both_ways on a = doc_id)
select n.doc_id, n.n as n_shingles, min(root) as component_id from n join reach using (doc_id) group by 1, 2"""

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s) where rank <= 10"""

NEAR_DUP = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, root) as (select vec_id, vec_id from embeddings union select b, root from reach join links on a = vec_id),
c as (select vec_id, min(root) as component_id from reach group by 1), n as (select a as vec_id, count(*) as n from links group by 1)
select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)"""

WARC = """with p as (select page_id, url, coalesce(html, '') as h from pages), d as (select *, sha1(h) as hex, min(page_id) over (partition by h) as first from p)
select page_id, strlen(h) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(hex, cast((i // 4) * 5 + 1 as int), 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as int), 1)), '') as payload_digest,
case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, coalesce(url, '') as url, true as verified from d"""

#: t: one row with the table of crc32, made by its rule.
_CRC_TABLE = """t as (select list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc)"""


def _crc32(hexed: str, size: str) -> str:
    """crc32 of bytes given as hex digits and their number, beside t."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, {size}), lambda i: cast('0x' || substr({hexed}, cast(2 * i + 1 as int), 2) as bigint))), lambda c, b: xor(crc[cast(1 + (xor(c, b) & 255) as int)], c >> 8)))"


SPELLING = f"""with recursive {_CRC_TABLE},
r as (select coalesce(cast(doc_id as varchar), '') as id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+'), lambda w: translate(w, '{_UPPER}', '{_LOWER}'))) as w from documents),
g as (select id, w, count(*) as n from r where length(w) >= 5 group by 1, 2),
x as (select id, w, n, hex(encode(id || ':' || w)) as hx, strlen(id || ':' || w) as size from g),
h as (select w, n, {_crc32('hx', 'size')} as h from x cross join t),
o as (select case when h % 97 = 0 then substr(w, 1, cast(h % length(w) as int)) || substr(w, cast(h % length(w) as int) + 2) else w end as word, n from h),
v as (select word, cast(sum(n) as bigint) as n from o where length(word) >= 5 group by 1 having sum(n) >= 3),
d as (select word, n, unnest(range(1, length(word) + 1)) as i from v), e as (select word, n, i, substr(word, 1, cast(i as int) - 1) || substr(word, cast(i as int) + 1) as cut from d),
p as (select a.word as x, b.word as y, b.n as y_n from e a join e b on a.cut = b.cut and a.i = b.i and a.word <> b.word
union select e.word, v.word, v.n from e join v on e.cut = v.word union select v.word, e.word, e.n from e join v on e.cut = v.word),
k as (select x, count(*) as n_near, max(y_n) as most from p group by 1), b as (select p.x, n_near, most, min(y) as form from p join k using (x) where y_n = most group by 1, 2, 3),
f as (select word, n, case when most >= 2 * n then form end as form, cast(coalesce(n_near, 0) as bigint) as n_near, case when most >= 2 * n then most end as form_n from v left join b on x = word),
path(word, last) as (select word, word from f union all select path.word, f.form from path join f on f.word = path.last where f.form is not null),
ends as (select path.word, path.last as root from path join f on f.word = path.last where f.form is null)
select f.word, n, form, root, n_near, form_n from f join ends using (word)"""

CONVERSATION_TRIE = f"""with {_CRC_TABLE},
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
x as (select conv_id, conv_id - conv_id % 100 as source, count(*) as n, hex(encode(cast(conv_id as varchar))) as hx, strlen(cast(conv_id as varchar)) as size from own group by 1),
c as (select conv_id, source, n, {_crc32('hx', 'size')} % 6 as h from x cross join t),
z as (select c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) as take from c left join c b on b.conv_id = c.source),
turns as (select c.conv_id, own.k as pos, role, text from c join own on own.conv_id = c.source and own.k < c.h union all select conv_id, take + k - h, role, text from own join z using (conv_id) where k >= h),
s as (select conv_id, list({{'r': role, 't': text}} order by pos) as a from turns group by 1), w as (select c.conv_id, coalesce(a, []) as a from c left join s using (conv_id)),
m as (select conv_id, a, unnest(range(0, len(a) + 1)) as depth from w), q as (select conv_id, depth, len(a) as total, a[:depth] as prefix from m),
l as (select conv_id, depth, total, min(conv_id) over (partition by depth, prefix) as node, length(prefix[depth].t) as chars from q),
nodes as (select node, depth, count(*) as n, coalesce(any_value(chars), 0) as chars, coalesce(string_agg(case when total = depth then cast(conv_id as varchar) end, ',' order by conv_id), '') as ends from l group by 1, 2),
up as (select distinct c.node, c.depth, p.node as parent from l c join l p on p.conv_id = c.conv_id and p.depth = c.depth - 1),
kids as (select parent as node, depth - 1 as depth, count(*) as n_kids from up group by 1, 2),
full_nodes as (select nodes.node, nodes.depth, parent, n, chars, ends, coalesce(n_kids, 0) as n_kids from nodes left join kids using (node, depth) left join up on up.node = nodes.node and up.depth = nodes.depth),
below as (select l.node as above, l.depth as above_depth, f.n_kids, (f.n - 1) * f.chars as saved from full_nodes f join l on l.conv_id = f.node and l.depth <= f.depth),
sums as (select above as node, above_depth as depth, count(*) filter (n_kids = 0) as n_leaves, sum(saved) as saved from below group by 1, 2)
select node as conv_id, cast(depth as bigint) as depth, parent as parent_conv_id, cast(n as bigint) as n_convs, cast(n_kids as bigint) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from full_nodes join sums using (node, depth)"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op2_topk": TOP_K, "op3_near_dup": NEAR_DUP, "op6_warc": WARC, "op12_spelling": SPELLING, "op13_conversation_trie": CONVERSATION_TRIE}
