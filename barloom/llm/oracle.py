"""DuckDB SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

from .repetition import GRAM_LIMITS, LINE_CHAR_LIMIT, LINE_LIMIT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
with w as (select doc_id, {WORDS} ws from documents),
win as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) s from w where len(ws) >= 20)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) r from win) where r > 1),
gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) p from later),
word as (select doc_id, unnest(ws) x, unnest(generate_series(1, len(ws))) p from w),
kept as (select doc_id, count(g.p) n_removed, string_agg(x, ' ' order by p) filter (g.p is null) t from word left join gone g using (doc_id, p) group by 1)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)"""

WIDE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WIDE}') ws from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WIDE}') ws from benchmark),
bw as (select distinct item, n, array_to_string(ws[s:s + n - 1], ' ') k from (select item, ws, least(10, len(ws)) n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) s from b where len(ws) > 0)),
dw as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') k from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) s from d, (select distinct n from bw) where len(ws) >= n)),
hit as (select doc_id, item, s, n from dw join bw using (n, k)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) p from hit) group by 1),
items as (select doc_id, list_sort(list(distinct item)) i from hit group by 1)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(len(i), 0) as bigint) n_items, sha256(coalesce(array_to_string(i, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK}'), lambda x: x <> '') ws from documents),
g as (
  select distinct doc_id, array_to_string(ws[s:s + 3], ' ') k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 3)) s from w where len(ws) >= 4)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3),
n as (select doc_id, count(*) n from g group by 1),
links as (select a, b from (select x.doc_id a, y.doc_id b, count(*) c from g x join g y on x.k = y.k and x.doc_id <> y.doc_id group by 1, 2) p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c component_id, doc_id = c kept from (select a doc_id, min(b) c from reach group by 1) left join n using (doc_id)"""

_NS = ", ".join(f"({n}, {most})" for n, most in GRAM_LIMITS.items())
REPETITION = f"""
with w as (select doc_id, coalesce(text, '') t, {WORDS} ws from documents),
win as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') k from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) s from w, (values {_NS}) v(n, most) where len(ws) >= n)),
dup as (select distinct doc_id, n, unnest(generate_series(s, s + n - 1)) p from (select *, count(*) over (partition by doc_id, n, k) c from win) where c > 1),
chars as (select doc_id, n, count(*) c, sum(length(ws[p])) x from dup join w using (doc_id) group by 1, 2),
lines as (select doc_id, line, row_number() over (partition by doc_id, line) r, list_sum(list_transform(list_filter(string_split_regex(line, '{BLANK}'), lambda z: z <> ''), lambda z: length(z))) x
  from (select doc_id, unnest(string_split(t, chr(10))) line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l as (select doc_id, count(*) n_lines, count(*) filter (r > 1) dups, coalesce(sum(x) filter (r > 1), 0) dup_chars from lines group by 1),
m as (
  select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(coalesce(dups, 0) as bigint) n_dup_lines, cast(coalesce((select c from chars where chars.doc_id = w.doc_id and n = 5), 0) as bigint) n_repeat_words, coalesce(n_lines, 0) n_lines, coalesce(dup_chars, 0) dup_chars
  from w left join l using (doc_id)),
bad as (select distinct doc_id from chars join (values {_NS}) v(n, most) using (n) join m using (doc_id) where x > word_chars * most)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_dup_lines > n_lines * {LINE_LIMIT} or dup_chars > word_chars * {LINE_CHAR_LIMIT} or doc_id in (select doc_id from bad)) kept
from m"""


#: crc32 of the id as text, bit by bit: a byte is mixed in, then come eight steps, marked -1.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295::bigint)"""

PERIODIC_RUNS = f"""
with w as materialized (select doc_id, {WORDS} ws, {CRC} h from documents),
placed as (select doc_id, ws, len(ws) n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) else len(ws) end a, h // 10 g from w),
word as materialized (
  select doc_id, n, i, ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end] x
  from (select *, unnest(generate_series(0, n - 1)) i from placed where n > 0)),
pair as (select a.doc_id, a.n, b.i - a.i q, a.i from word a join word b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and b.i - a.i <= a.n // 4),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) k from pair),
stretch as (select doc_id, min(i) s, max(i) + q + 1 e, q from island group by doc_id, q, k having max(i) + q + 1 - min(i) >= greatest(6, 4 * q)),
run as materialized (select doc_id, s, e - s l, min(q) q from stretch group by doc_id, s, e),
listed as (select doc_id, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) t, list(row(s, l, q) order by l / q desc, s, q)[1] best from run group by 1),
gone as (select distinct doc_id, unnest(generate_series(s + q, s + l - 1)) i from run),
kept as (select word.doc_id, string_agg(x, ' ' order by word.i) filter (gone.i is null) t from word left join gone using (doc_id, i) group by 1)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(best[1] as bigint) "start", cast(best[2] as bigint) length, cast(best[3] as bigint) period, cast(best[2] * 1000 // best[3] as bigint) exponent_milli,
  sha256(coalesce(listed.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from w left join listed using (doc_id) left join kept using (doc_id)"""


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _tree(name: str, nodes: str) -> str:
    """All levels of the trees over nodes (tree, p, n, h), and each node's siblings to the left and right."""
    frame = "over (partition by k, tree, p // 8 order by p rows between"
    return f"""
{name}(k, tree, p, n, h) as (select 0, tree, p, n, h from {nodes} union all select k + 1, tree, p // 8, max((n + 7) // 8), sha256(string_agg(h, '' order by p)) from {name} where n > 1 group by k, tree, p // 8),
{name}_near as (select k, tree, p, n, h, coalesce(string_agg(h, '') {frame} unbounded preceding and 1 preceding), '') l, coalesce(string_agg(h, '') {frame} 1 following and unbounded following), '') r from {name})"""


def _walk(name: str, tree: str, first: str) -> str:
    """From the nodes of first (doc_id, tree, p) up: siblings so far, and what the digest d folds to."""
    return f"""
{name}(doc_id, k, tree, p, sib, d) as ({first} union all
  select w.doc_id, w.k + 1, w.tree, w.p // 8, w.sib || l || r, sha256(l || w.d || r) from {name} w join {tree}_near t using (k, tree, p) where t.n > 1)"""


MERKLE = f"""
with recursive leaf as materialized (
  select doc_id, lang, {_leaf("text")} h, case when {CRC} % 3 = 0 then {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} else {_leaf("text")} end t from documents),
placed as materialized (select *, dense_rank() over (order by lang nulls first) - 1 tree, row_number() over (partition by lang order by doc_id nulls first) - 1 p, count(*) over (partition by lang) n from leaf),{_tree("low", "placed")},
sub as (select tree, h, tree p, count(*) over () n from low where n = 1),
subs as (select 0 tree, p, n, h from sub),{_tree("up", "subs")},{_walk("climb", "low", "select doc_id, 0, tree, p, '', t from placed")},
half as (select c.* from climb c join low using (k, tree, p) where low.n = 1),{_walk("rise", "up", "select doc_id, 0, 0, tree, sib, d from half")},
done as (select r.doc_id, sib, d, up.h root from rise r join up using (k, tree, p) where up.n = 1)
select doc_id, placed.h leaf, sub.h subroot, root, sha256(sib) proof_sha256, d folded_root, d = root verified from placed join sub using (tree) join done using (doc_id)"""
