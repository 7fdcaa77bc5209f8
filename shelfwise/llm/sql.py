"""SQL for the queries that it can express."""

from __future__ import annotations

from shelfwise.llm.quality import RULES, STOP_WORDS
from shelfwise.llm.secret_scan import BASE
from shelfwise.llm.secret_scan import RULES as RULES_OF_SECRETS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " and ".join(
    f"{rule.measure} {sign} {bound}"
    for rule in RULES
    for sign, bound in ((">=", rule.least), ("<=", rule.most))
    if bound is not None
)

#: doc_id, text, measures, base_failed and kept of each row
QUALITY = f"""
docs as (select row_number() over () as r, * from documents),
worded as (
  select r, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from docs),
starts as (select r, w, unnest(range(1, len(w) - 6)) as i from worded),
windows as (select r, i, count(*) over (partition by r, w[i:i + 7]) as n from starts),
covered as (select distinct r, i + d as p from windows, range(8) as s(d) where n > 1),
repeated as (select r, count(*) as n_repeat_words from covered group by r),
counted as (
  select r, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) as capitals,
         len(list_filter(w, lambda x: x in ({_STOPS}))) as stops,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as same
  from worded),
measured as (
  select counted.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         word_chars / greatest(n_words, 1) as mean_word_length, n_symbols / greatest(n_words, 1) as symbol_ratio,
         capitals / greatest(word_chars, 1) as capital_ratio, stops / greatest(n_words, 1) as stop_word_ratio,
         n_dup_lines / greatest(n_lines, 1) as duplicate_line_ratio, same / greatest(n_words, 1) as same_as_previous_ratio
  from counted left join repeated using (r)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from measured),
assessed as (
  select docs.* exclude (r), judged.* exclude (r), not base_failed and {_RULES} as kept from docs join judged using (r))
"""


def similar(words: int, part: int, whole: int, source: str) -> str:
    """CTEs that end in `grouped` (doc_id, n_shingles, component_id, kept) for the rows of `source`."""
    return f"""
tokens as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') as w
  from {source}),
shingles as (
  select distinct r, w[i:i + {words} - 1] as s
  from (select r, w, unnest(range(1, greatest(len(w) - {words} + 1, least(len(w), 1)) + 1)) as i from tokens)),
sizes as (select r, count(*) as n from shingles group by r),
common as (select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.r < b.r
           group by all),
links as (select a, b from common join sizes x on x.r = a join sizes y on y.r = b
          where {whole} * common.n >= {part} * (x.n + y.n - common.n)),
steps as (select a, b from links union all select b, a from links),
reach as (select r as a, r as b from tokens union select reach.a, steps.b from reach join steps on steps.a = reach.b),
grouped as (
  select t.doc_id, coalesce(any_value(sizes.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id,
         t.doc_id is not distinct from min(o.doc_id) as kept
  from tokens t join reach on reach.a = t.r join tokens o on o.r = reach.b left join sizes on sizes.r = t.r
  group by t.r, t.doc_id)
"""


def _secrets() -> str:
    """Spans of each rule: what lies between matches gives their places."""
    parts = []
    for k, rule in enumerate(RULES_OF_SECRETS):
        regex = rule.regex.replace("'", "''")
        parts.append(f"""
  select r, {k} as k, '{rule.kind}' as kind, unnest(regexp_extract_all(t, '{regex}')) as m,
         unnest(string_split_regex(t, '{regex}')[:-2]) as gap, unnest(range(len(regexp_extract_all(t, '{regex}')))) as i,
         '{regex}' as re, {rule.group} as g, {rule.least} as least
  from texts where regexp_matches(t, '{regex}')""")
    counts = ", ".join(
        f"count(*) filter (kind = '{rule.kind}')::bigint as n_{rule.kind}" for rule in RULES_OF_SECRETS[:BASE]
    )
    return f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
matches as ({" union all ".join(parts)}),
ends as (select *, sum(length(gap) + length(m)) over (partition by r, k order by i) as e from matches),
spans as (select r, k, kind, (e - length(m))::bigint as s, e::bigint as e from ends
          where length(case when g = 0 then m else regexp_extract(m, '{RULES_OF_SECRETS[0].regex.replace("'", "''")}', 2)
                       end) >= least)
select doc_id, {counts},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {BASE}), ''))
         as base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (kind is not null), '') as spans
from texts left join spans using (r) group by r, doc_id"""


_VECTORS = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {i + 1}, 5))::int >> {s}) & 31) + 1)::int, 1)"
    for i in range(0, 40, 5)
    for s in (15, 10, 5, 0)
)
_ARCHIVE = f"""
with p as (select page_id, url, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
n as (select *, row_number() over (partition by t order by page_id nulls last, url nulls last) as place,
             first_value(page_id) over (partition by t order by page_id nulls last, url nulls last) as one from p)
select page_id, strlen(t)::bigint as payload_bytes, {_LETTERS} as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type,
       case when place > 1 then one end as refers_to
from n"""

#: (v): the table of the CRC-32 of each byte, from its polynomial
_CRC = """
bits(i, c, k) as (
  select range::ubigint, range::ubigint, 0 from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits
            where k < 8),
crc as (select list(c order by i) as v from bits where k = 8)
"""


def _crc32(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::int, 1))::ubigint)"
    step = "lambda a, b: xor(a >> 8, v[(xor(a, b) & 255)::int + 1])"
    return f"xor(list_reduce({codes}, {step}, 4294967295::ubigint), 4294967295::ubigint)::bigint"


_TRIE = f"""
with recursive {_CRC},
said as (
  select conv_id, turn, strlen(coalesce(text, '')) as bytes,
         substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as id
  from conversations where conv_id is not null),
own as (
  select conv_id, list(id order by turn nulls first, id) as ids, list(bytes order by turn nulls first, id) as sizes
  from said group by conv_id),
planned as (select own.*, conv_id - conv_id % 5 as base, {_crc32("conv_id::varchar")} % 9 as h from own, crc),
rebuilt as (
  select p.conv_id, list_concat(coalesce(b.ids[1:p.h], []), p.ids[p.h + 1:]) as ids,
         list_concat(coalesce(b.sizes[1:p.h], []), p.sizes[p.h + 1:]) as sizes
  from planned p left join own b on b.conv_id = p.base),
prefixes as (
  select conv_id, d, ids[1:d] as p, case when d > 0 then sizes[d] else 0 end as bytes, d = len(ids) as ends
  from (select *, unnest(range(len(ids) + 1)) as d from rebuilt)),
nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n, max(bytes) as bytes,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by p, d),
children as (select p[1:d - 1] as p, count(*) as n_children from nodes where d > 0 group by all),
trees as (
  select a.p, count(*) filter (c.p is null)::bigint as n_leaves, sum((b.n - 1) * b.bytes)::bigint as saved_tokens
  from nodes a join nodes b on b.d >= a.d and b.p[1:a.d] = a.p left join children c on c.p = b.p group by a.p)
select n.conv_id, n.d::bigint as depth, up.conv_id as parent_conv_id, n.n as n_convs,
       coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n join trees using (p) left join children using (p)
left join nodes up on n.d > 0 and up.d = n.d - 1 and up.p = n.p[1:n.d - 1]"""


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"case when {f} is null then '-' else strlen({f}::varchar) || ':' || {f}::varchar end" for f in fields]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, source: str) -> str:
    """Nodes (k, level, pos, digest, n) above the rows of `source` (k, pos, digest, n)."""
    return f"""{name}(k, level, pos, digest, n) as (
  select k, 0, pos, digest, n from {source}
  union all
  select k, level + 1, pos // 3, sha256(string_agg(digest, '' order by pos)), max((n + 2) // 3) from {name}
  where n > 1 group by k, level, pos // 3)"""


def _beside(level: int, tree: str, k: str, pos: str) -> str:
    own = f"({pos} // (3 ** t.level)::bigint)"
    return f"""
  select r, {level} + t.level as level, coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos < {own}), '') as l,
         coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos > {own}), '') as r_
  from placed join {tree} t on t.k = {k} and t.n > 1 and t.pos // 3 = {own} // 3 group by r, t.level"""


_MANIFEST = f"""
with recursive {_CRC},
leaves as (
  select row_number() over () as r, doc_id, source, coalesce(strlen(source) || ':' || source, '-') as k,
         {_leaf("text")} as digest,
         case when {_crc32("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")}
         end as now
  from documents, crc),
ranked as (
  select *, row_number() over (partition by k order by doc_id nulls first, digest) - 1 as pos,
         count(*) over (partition by k) as n from leaves),
{_tree("inner_", "ranked")},
subroots as (
  select 'all' as k, i.k as name, digest, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n
  from inner_ i join (select distinct k, source from leaves) s on s.k = i.k where i.n = 1),
{_tree("outer_", "subroots")},
placed as (
  select ranked.r, ranked.k, ranked.pos, subroots.pos as name_pos, subroots.digest as subroot
  from ranked join subroots on subroots.name = ranked.k),
sides as ({_beside(0, "inner_", "placed.k", "placed.pos")} union all {_beside(100, "outer_", "'all'", "placed.name_pos")}),
steps as (select *, row_number() over (partition by r order by level) as i from sides),
folded(r, i, digest) as (
  select r, 0, now from leaves
  union all select f.r, f.i + 1, sha256(l || digest || r_) from folded f join steps s on s.r = f.r and s.i = f.i + 1),
proofs as (select r, string_agg(l || r_, '' order by level) as proof from sides group by r),
last as (select r, max_by(digest, i) as folded_root from folded group by r)
select doc_id, ranked.digest as leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root,
       folded_root = root as verified
from ranked join placed using (r) join last using (r) left join proofs using (r),
     (select digest as root from outer_ where n = 1)"""

ORACLES: dict[str, str] = {
    "op3_trigram_secrets": _secrets(),
    "op7_histogram_top_k": _VECTORS,
    "op8_content_archive": _ARCHIVE,
    "op4_minhash_odd_sketch": f"with recursive {similar(3, 85, 100, 'documents')} select * from grouped",
    "op6_quality_rules": f"with {QUALITY} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, "
    "base_failed, kept from assessed",
    "op12_burst_trie": _TRIE,
    "op13_level_strings": _MANIFEST,
}
