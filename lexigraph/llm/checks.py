"""SQL that the queries must agree with, for operators that SQL can express."""

from __future__ import annotations

from lexigraph.llm.quality import RULES, SYMBOLS

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""with recursive word as (select doc_id, {WORDS.format(f"coalesce({FOLDED}, '')")} as w from documents),
    shingle as (
      select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else cast([] as varchar[]) end) as s from word),
    size as (select doc_id, count(*) as n from shingle group by doc_id),
    pair as (select a.doc_id as x, b.doc_id as y, count(*) as common from shingle a join shingle b using (s) where a.doc_id < b.doc_id group by all),
    link as (select x, y from pair join size p on p.doc_id = x join size q on q.doc_id = y where 100 * common >= 75 * (p.n + q.n - common)),
    edge as (select x, y from link union all select y, x from link),
    reach(doc_id, root) as (select doc_id, doc_id from documents union select edge.y, reach.root from reach join edge on edge.x = reach.doc_id)
    select doc_id, coalesce(n, 0) as n_shingles, least as component_id
    from (select doc_id, min(root) as least from reach group by doc_id) left join size using (doc_id)"""


def _quality(alpha: float = 0.05, delta: float = 0.05) -> str:
    tries = ", ".join(f"({r}, '{rule.name}', {i}, cast({c} as double))" for r, rule in enumerate(RULES) for i, c in enumerate(rule.cutoffs))
    value = "case rule " + " ".join(f"when '{r.name}' then {r.measure}" for r in RULES) + " end"
    p = alpha / len(RULES)
    term = f"exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({p}) + (good - i) * ln(1 - {p}))"
    return rf"""with word as (select doc_id, lang, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as w from documents),
    line as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from word),
    window_of as (select doc_id, unnest(t) as t, generate_subscripts(t, 1) as pos from (
      select doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as t from word)),
    often as (select doc_id, pos from (select *, count(*) over (partition by doc_id, t) as n from window_of) where n > 1),
    repeated as (select doc_id, count(distinct pos + o) as n from often, (values (0), (1), (2)) v(o) group by doc_id),
    counted as (
      select doc_id, lang, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, length(text) - length(translate(text, '!?', '')) as n_marks,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
        coalesce(repeated.n, 0) as n_repeat_words
      from word join line using (doc_id) left join repeated using (doc_id)),
    fact as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
    rule_of(number, rule, tried, cutoff) as (values {tries}),
    known as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id),
    sound as (select fact.* from fact join known using (doc_id) where quality = 1 and not base_failed),
    trial as (select lang, number, rule, tried, cutoff, count(*) as good, sum(cast({value} > cutoff as int)) as rejected from sound, rule_of group by all),
    tested as (select *, case when rejected >= good * {p} then 1.0 else list_sum(list_transform(range(0, cast(rejected as bigint) + 1), lambda i: {term})) end as p_value from trial),
    passed as (select *, min(cast(p_value <= {delta} / ((select count(distinct coalesce(lang, '') || cast(lang is null as varchar)) from sound) * {len(RULES)}) as int))
      over (partition by lang, rule order by tried) as holds from tested),
    chosen as (select lang, number, rule, arg_max(cutoff, tried) as cutoff from passed where holds = 1 group by all),
    failing as (select doc_id, array_to_string(list(rule order by number), ',') as failed
      from fact join chosen on fact.lang is not distinct from chosen.lang where {value} > cutoff group by doc_id)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed is null as kept, coalesce(failed, '') as failed
    from fact left join failing using (doc_id)"""


QUALITY = _quality()

# crc32 of the decimal id, bit by bit: a byte is taken in, then eight times a bit is shifted out (-1)
_CRC = """xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295)"""

TRIE = f"""with turned as (
      select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
      from conversations where conv_id is not null),
    conv as (select conv_id, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from (select distinct conv_id from turned)),
    rebuilt as (
      select c.conv_id, t.pos as d, t.role, t.text from conv c join turned t on t.conv_id = c.base where t.pos <= c.h
      union all
      select c.conv_id, (select count(*) from turned b where b.conv_id = c.base and b.pos <= c.h) + t.pos - c.h, t.role, t.text
      from conv c join turned t using (conv_id) where t.pos > c.h),
    prefix as (
      select conv_id, 0 as d, '' as node, 0 as chars from conv
      union all
      select conv_id, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
        over (partition by conv_id order by d rows between unbounded preceding and current row), length(text) from rebuilt),
    size as (select conv_id, max(d) as n from prefix group by conv_id),
    node as (
      select d, node, min(prefix.conv_id) as conv_id, count(*) as n_convs, max(chars) as chars, max(n) as deepest,
        coalesce(string_agg(case when d = n then cast(prefix.conv_id as varchar) end, ',' order by prefix.conv_id), '') as ends
      from prefix join size on size.conv_id = prefix.conv_id group by d, node),
    up as (select b.d, b.node, a.conv_id as parent_conv_id, a.node as parent
      from node b join prefix p on p.conv_id = b.conv_id and p.d = b.d - 1 join node a on a.d = p.d and a.node = p.node),
    child as (select d - 1 as d, parent as node, count(*) as n_children from up group by all),
    below as (
      select p.d, p.node, sum((v.n_convs - 1) * v.chars) as saved_tokens, sum(cast(v.deepest = v.d as int)) as n_leaves
      from prefix p join prefix q on q.conv_id = p.conv_id and q.d >= p.d join node v on v.conv_id = q.conv_id and v.d = q.d and v.node = q.node group by p.d, p.node)
    select node.conv_id, cast(node.d as bigint) as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves,
      cast(saved_tokens as bigint) as saved_tokens, sha256(ends) as ends_sha256
    from node left join up on up.d = node.d and up.node = node.node left join child on child.d = node.d and child.node = node.node
    join below on below.d = node.d and below.node = node.node"""
