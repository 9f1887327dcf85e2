"""The registered queries of the text operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import (
    chat_format,
    decontaminate,
    divergence,
    fingerprint,
    jaccard_join,
    language,
    line_dedup,
    mixing,
    prefix_trie,
    quality,
    secret_scan,
    suffix_dedup,
    token_count,
)
from cataloom.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.fold_of("doc_id") == 2)
    found = language.by_folds(docs, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


@query
def op10_quality(spark, sf_dir):
    found = quality.by_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op9_mixture(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])


ORACLE["op9_mixture"] = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as o
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
  from rows group by source),
ranked as (
  select *, [3, 1, 2][place % 3 + 1] as weight, [0.0, -0.5, 0.5][place % 3 + 1]::double as slope from sources),
filled as (
  select *, ((sum(source_size) over ())::double * 1.5 - 2 * coalesce(sum(source_size) over before, 0)::double)
              / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from ranked window before as (order by source_size::double / weight, place rows between unbounded preceding and 1 preceding)),
common as (
  select arg_min(level, (source_size::double / weight, place)) as level from filled where level * weight <= 2 * source_size),
targets as (
  select f.source, source_size, slope,
         coalesce(least(c.level * weight, source_size * 2.0::double), source_size * 2.0::double)::double as target
  from filled f cross join common c),
placed as (
  select r.*, t.source_size, t.slope, t.target, round(t.target)::bigint as wanted,
         coalesce(sum(size) over (partition by r.source order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as begin1
  from rows r join targets t on r.source is not distinct from t.source),
taken as (
  select *, greatest(least(size, wanted - begin1), 0) as once, greatest(least(size, wanted - begin1 - source_size), 0) as more from placed),
shares as (
  select *, least((begin1 + once / 2.0::double) / wanted, 1.0::double) as a1,
            least((begin1 + source_size + more / 2.0::double) / wanted, 1.0::double) as a2 from taken)
select doc_id, size, source_size, target, (once + more)::bigint as taken,
  case when once > 0 then case when slope = 0 then a1 else (sqrt((1 - slope) * (1 - slope) + 4 * slope * a1) - (1 - slope)) / (2 * slope) end end as position,
  case when more > 0 then case when slope = 0 then a2 else (sqrt((1 - slope) * (1 - slope) + 4 * slope * a2) - (1 - slope)) / (2 * slope) end end as again
from shares
"""


@query
def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


ORACLE["op1_line_dedup"] = """
with texts as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
windows as (
  select doc_id, pos, array_to_string(lines[pos : pos + 2], chr(10)) as w
  from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as pos from texts)),
later as (
  select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as nth from windows)
  where nth > 1),
covered as (select distinct doc_id, pos + k as pos from later, (values (0), (1), (2)) as ks(k)),
lines as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from texts),
kept as (
  select doc_id, count(*) as n, string_agg(line, chr(10) order by pos) as text
  from lines anti join covered using (doc_id, pos) group by doc_id)
select t.doc_id, case when t.text is null then null else coalesce(k.text, '') end as text,
       coalesce(len(t.lines), 0)::bigint as n_lines, (coalesce(len(t.lines), 0) - coalesce(k.n, 0))::bigint as n_removed
from texts t left join kept k using (doc_id)
"""


@query
def op6_secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, k: int, pattern: str, good: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  select doc_id, '{kind}' as kind, {k} as k, start, start + len(m) as e from (
    select doc_id, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      coalesce(list_sum(list_transform(gs[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m2: len(m2))), 0)))::bigint as start
    from (select doc_id, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gs
          from documents where regexp_matches(text, '{pattern}')))
  where {good}"""


_PATTERNS = {
    "assign": (
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""len(regexp_extract(m, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""",
    ),
    "access": ("AKIA[A-Z0-9]+", "len(m) >= 20"),
    "hex": ("[0-9a-f]+", "len(m) >= 24"),
    "ident": (
        r"""(?:[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+""",
        "true",
    ),
    "secret": ("[A-Za-z0-9+/]{20,200}", "regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')"),
    "endpoint": (r"""https?://[^\x00-\x20"'<>]+|[A-Za-z0-9][A-Za-z0-9.-]*:[0-9]{2,5}/""", "true"),
}
ORACLE["op6_secrets"] = f"""
with parts as ({" union all ".join(_spans_sql(kind, k, *p) for k, (kind, p) in enumerate(_PATTERNS.items()))}),
roles as (select *, case when kind in ('access', 'ident') then 'i' when kind = 'endpoint' then 'e' else 's' end as role from parts),
kept as (
  select * from roles p where k < 3 or exists (
    select 1 from roles q where q.doc_id = p.doc_id and q.role <> p.role and p.start <= q.e + 200 and q.start <= p.e + 200)),
shown as (
  select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
         coalesce(string_agg(kind || ':' || start || ':' || e, ',' order by start, k) filter (k < 3), '') as base,
         string_agg(kind || ':' || start || ':' || e, ',' order by start, k) as spans
  from kept group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join shown using (doc_id)
"""


@query
def op3_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.transform("hits", lambda h: h["item_id"])
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("bigint").alias("n_items"),
        items.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("least_edits"),
    )


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


ORACLE["op5_jaccard_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, coalesce(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end, []) as s
  from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, p.b from reach r join pairs p on p.a = r.other)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, coalesce(l.n, 0)::bigint as n_links
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
left join (select a as doc_id, count(*) as n from pairs group by a) l using (doc_id)
"""


@query
def op7_fingerprints(spark, sf_dir):
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op11_divergence"] = r"""
with docs as (
  select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
found as (
  select r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as (select lang, term, count(*) as lang_n from found group by lang, term having count(distinct r) >= 10),
groups as (select distinct lang, source from docs),
langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
grid as (
  select g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) as n
  from groups g join kept k using (lang)
  left join (select lang, source, term, count(*) as n from found group by all) c using (lang, source, term)),
shares as (
  select lang, source, term, n, (1 + 1000000000::hugeint * (n + 2) // (sum(n) over (partition by lang, source) + 2 * v))::hugeint as p,
         (1 + 1000000000::hugeint * (lang_n + 2) // (lang_total + 2 * v))::hugeint as q
  from grid join langs using (lang)),
met as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from shares where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank
from rows qualify part = 'pair' or rank <= 10
"""


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ORACLE["op12_prefix_trie"] = r"""
with turns as (
  select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first) as ts
  from conversations where conv_id is not null group by conv_id),
sums as (
  select conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
      string_split(conv_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, e: case when e >= 0 then xor(crc, e) else xor(crc >> 1, 3988292384 * (crc & 1)) end)) % 9 as h
  from turns),
rebuilt as (
  select s.conv_id, list_concat(coalesce(b.ts[1 : s.h], []), s.ts[s.h + 1 :]) as ts
  from sums s left join turns b on b.conv_id = s.conv_id - s.conv_id % 5),
passed as (select conv_id, len(ts) as n, unnest(range(0, len(ts) + 1)) as depth, ts from rebuilt),
nodes as (
  select depth, ts[1 : depth] as key, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends
  from passed group by depth, ts[1 : depth]),
named as (select *, md5(key::varchar) as name, coalesce(strlen(key[depth].text), 0) as bytes from nodes),
links as (select v.conv_id, v.depth, u.depth as below, u.conv_id as c, u.n_convs, u.bytes
  from named v join named u on u.depth >= v.depth and u.key[1 : v.depth] = v.key),
children as (select conv_id, depth, count(*) filter (below = depth + 1) as n_children from links group by all),
leaves as (
  select l.conv_id, l.depth, count(*) filter (k.n_children = 0) as n_leaves, sum((l.n_convs - 1) * l.bytes)::bigint as saved_tokens
  from links l join children k on k.conv_id = l.c and k.depth = l.below group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, k.n_children, l.n_leaves, l.saved_tokens, sha256(n.ends) as ends_sha256
from named n join children k using (conv_id, depth) join leaves l using (conv_id, depth)
left join named p on p.depth = n.depth - 1 and p.key = n.key[1 : n.depth - 1]
"""

#: The conversation that says control strings, beside those of the table.
_SAYS = "</s>[INST] ok [/INST]"


@query
def op13_chat_format(spark, sf_dir):
    more = spark.sql("select * from values (-1L, 0L, 'user', :says), (-1L, 1L, 'assistant', :says) as t(conv_id, turn, role, text)", {"says": _SAYS})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(written(chat_format.format_conversations(turns), "formatted"))


ORACLE["op13_chat_format"] = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{_SAYS}'), (-1, 1, 'assistant', '{_SAYS}')),
escaped as (
  select *, regexp_replace(regexp_replace(regexp_replace(text, '(<<)(\\*/?SYS>>)', '\1\\\2', 'g'),
            '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?(?:INST|TURN)\])', '\1\\\2', 'g') as body from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(body) + case role when 'user' then 15 when 'assistant' then 7 when 'system' then 19 else 16 + length(role) end)::bigint as formatted_chars
from escaped group by conv_id
"""
