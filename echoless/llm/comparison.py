"""SQL that says what the operators give, where SQL can say it."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

BENCHMARK_PASSAGES = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct cast(item_id as varchar) as item, least(10, len(w)) as m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
dw as (select doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s from d, (select distinct m from iw) where len(w) >= m)),
hit as (select doc_id, s, dw.m, item from dw join iw on dw.g = iw.g and dw.m = iw.m),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hit) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)"""

REPEATED_PASSAGES = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, s, array_to_string(w[s : s + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13)),
f as (select g, min(doc_id) as first from g group by g),
r as (select distinct doc_id, unnest(range(s, s + 13)) as p from g join f using (g) where first < doc_id),
k as (select doc_id, string_agg(x, ' ' order by p) as kept from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) anti join r using (doc_id, p) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join (select doc_id, count(*) as n from r group by doc_id) using (doc_id) left join k using (doc_id)"""

EQUAL_TEXTS = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256 from n"""

#: Checksum of a doc_id's digits, bit by bit, as in zlib. Fixed value: the polynomial 0xEDB88320.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_LEAF = "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars")) + ", coalesce(strlen({text})::varchar || ':' || {text}, '-')))"


def _levels(name: str, nodes: str) -> str:
    """SQL for all nodes (tree, level, i, h, n) over `nodes`, of which each tree has n."""
    return f"""{name} as (select tree, 0 as level, i, h, n from {nodes} union all
  select tree, level + 1, i // 8, sha256(string_agg(h, '' order by i)), max((n + 7) // 8) from {name} where n > 1 group by tree, level, i // 8)"""


def _sides(name: str, levels: str, leaves: str) -> str:
    """SQL for the siblings left and right of the path of each of the leaves (tree, i)."""
    return f"""{name} as (select l.tree, l.i as leaf_i, v.level, coalesce(string_agg(v.h, '' order by v.i) filter (v.i < l.i // (8 ** v.level)::bigint), '') as a,
  coalesce(string_agg(v.h, '' order by v.i) filter (v.i > l.i // (8 ** v.level)::bigint), '') as b
  from {leaves} l join {levels} v on v.tree = l.tree and v.n > 1 and v.i // 8 = l.i // (8 ** (v.level + 1))::bigint group by all)"""


MERKLE_MANIFEST = f"""with recursive
d as (select doc_id, coalesce('x' || lang, '') as tree, {_LEAF.format(text="text")} as h,
  case when coalesce({_CRC} % 3 = 0, false) then {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i, count(*) over (partition by tree) as n from d),
{_levels("v", "leaves")},
subroots as (select 0 as tree, tree as lang, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from v where n = 1),
{_levels("w", "subroots")},
{_sides("p", "v", "leaves")},
{_sides("q", "w", "subroots")},
height as (select tree, max(level) as top from v group by tree),
steps as (select tree, leaf_i, level, a, b from p union all
  select l.tree, l.i, height.top + q.level, a, b from leaves l join height using (tree) join subroots s on s.lang = l.tree join q on q.leaf_i = s.i),
proofs as (select tree, leaf_i as i, sha256(string_agg(a || b, '' order by level)) as proof_sha256 from steps group by all),
f as (select tree, i, 0 as level, coalesce(changed, h) as h from leaves union all
  select f.tree, f.i, f.level + 1, sha256(a || h || b) from f join steps s on s.tree = f.tree and s.leaf_i = f.i and s.level = f.level),
folds as (select tree, i, max_by(h, level) as folded_root from f group by all)
select doc_id, leaves.h as leaf, subroot, r.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = r.h as verified
from leaves join (select lang, h as subroot from subroots) s on lang = leaves.tree cross join (select h from w where n = 1) r join folds using (tree, i) left join proofs using (tree, i)"""

HARD_NEGATIVES = """
with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(256 * v::double)) as x
  from embeddings where vec_id is not null and label is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
a as (select * from r where vec_id % 100 = 0),
s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.x, r.x)::bigint as score from a join r on a.vec_id <> r.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select s.anchor_id, p.vec_id as positive_id, row_number() over (partition by s.anchor_id, p.vec_id order by s.score desc, s.vec_id)::integer as rank,
  s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from s join p on p.anchor_id = s.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score qualify rank <= 5"""
