"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

from cataloom.workload.fixtures import DEST, EXTENSIONS, LEXICON, SENTENCE

# Fixed values, spelled out here and not taken from the engine: a wrong one there must show.
EXTENSION_MAP = {
    "Images": [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp"],
    "Documents": [".pdf", ".docx", ".doc", ".txt", ".md", ".xlsx", ".csv", ".pptx"],
    "Audio": [".mp3", ".wav", ".flac", ".m4a", ".aac"],
    "Video": [".mp4", ".mov", ".mkv", ".avi", ".webm"],
    "Archives": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "Executables": [".exe", ".msi", ".bat", ".sh", ".app"],
    "Code": [".py", ".js", ".html", ".css", ".java", ".cpp"],
}
KEYWORD_TAGS = ["NOUN", "PROPN", "VERB", "ADJ"]
GENERIC_WORDS = ["page", "date", "file", "total", "text", "format", "number", "datum", "sheet"]


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ext(name: str) -> str:
    return rf"regexp_extract({name}, '^\.*[^.].*(\.[^.]*)$', 1)"


def _category(ext: str) -> str:
    whens = " ".join(f"when {ext} in ({_quoted(v)}) then '{k}'" for k, v in EXTENSION_MAP.items())
    return f"case {whens} else 'Others' end"


def _preview(text: str) -> str:
    parts = rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"
    return f"array_to_string(list_slice({parts}, 1, 500), ' ')"


def _numbered(name: str, suffix: str) -> str:
    ext = _ext(name)
    return (
        f"case when {suffix} = 0 then {name} else left({name}, length({name}) - length({ext})) "
        f"|| '_' || {suffix} || {ext} end"
    )


def _keyed(source: str, word: str) -> str:
    """``source`` with the number of the vector that belongs to ``word``."""
    return (
        f"(select *, ('0x' || substr(md5(lower({word})), 1, 8))::bigint % (select count(*) from embeddings) as vec_id "
        f"from {source})"
    )


def _norm(vec: str) -> str:
    return f"sqrt(list_dot_product({vec}, {vec}))"


def _toy(word: str) -> str:
    return f"list_transform(range(8), lambda i: (('0x' || substr(md5({word}), 2 * i::int + 1, 2))::bigint - 127.5)::double)"


_LEX = ", ".join(f"('{t}', '{l}', '{g}', {str(s).lower()})" for t, l, g, s in LEXICON)
_FOLDER = "'/in/' || lang || case when doc_id % 2 = 1 then '/sub' else '' end"
_KIND = f"([{_quoted(EXTENSIONS)}])[doc_id % {len(EXTENSIONS)} + 1]"


def _tokens_of(source: str, key: str, text: str) -> str:
    return (
        f"select {key}, unnest(range(len(w))) as pos, unnest(w) as text "
        rf"from (select {key}, list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: regexp_matches(t, '\p{{L}}')) as w from {source})"
    )


def _lookup(source: str) -> str:
    return f"""
      select t.*, coalesce(e.lemma, l.lemma, lower(t.text)) as lemma, coalesce(e.tag, l.tag, 'NOUN') as tag,
             coalesce(e.is_stop, l.is_stop, false) as is_stop
      from {source} t left join lex e on e.token = t.text left join lex l on l.token = lower(t.text)"""


def _keywords_of(source: str) -> str:
    """Ranked keywords of ``(path, preview)``, as one derived table."""
    return f"""
      select path, rank, keyword, n, first_pos from (
        select path, lemma as keyword, n, first_pos,
               row_number() over (partition by path order by n desc, first_pos) as rank
        from (select path, lemma, count(*) as n, min(pos) as first_pos
              from ({_lookup(f"({_tokens_of(source, 'path', 'preview')})")})
              where tag in ({_quoted(KEYWORD_TAGS)}) and not is_stop and length(text) > 2
                and lemma not in ({_quoted(GENERIC_WORDS)})
              group by path, lemma))
      where rank <= 20"""


def _matches(keywords: str) -> str:
    """Best score and target per file."""
    return f"""
      select path, max(score) as score, arg_max(label, (score, -idx)) as label, arg_max(idx, (score, -idx)) as idx
      from (select k.path, s.idx, s.label, s.score from {_keyed(keywords, 'keyword')} k join scored s using (vec_id))
      group by path"""


def _categorised(files: str, keywords: str) -> str:
    hit = "m.score > 0.45 and f.category in ('Documents', 'Images', 'Audio', 'Video')"
    return f"""
      select f.path, f.filename, f.scan_seq, f.category as ext_category,
             case when {hit} then upper(m.label[1]) || lower(m.label[2:]) else f.category end as category,
             case when {hit} then m.score end as score
      from {files} f left join ({_matches(keywords)}) m using (path)"""


def _planned(files: str, present: str) -> str:
    """Plan for names that never contend: the place in the queue is the suffix."""
    return f"""
      select path, category, filename, length, scan_seq,
             '{DEST}/' || category || '/' || {_numbered('filename', 'k')} as dest_path, k as n_suffix, 'planned' as status
      from (select *, row_number() over (partition by category, filename order by scan_seq) - 1 as k
            from {files} where path in (select path from {present}))
      union all
      select path, category, filename, length, scan_seq, null, null, 'missing_source'
      from {files} where path not in (select path from {present})"""


def _assembled(source: str, order: str) -> str:
    return f"select path, {_preview('j')} as preview from (select path, string_agg(text, ' ' order by {order}) as j from {source} group by path)"


def _owner(first: int, kinds: int) -> str:
    """The number of the file that a conversation's pieces go to."""
    n = len(EXTENSIONS)
    return f"(c.conv_id // {kinds}) % ((select count(*) from documents) // {n}) * {n} + {first} + c.conv_id % {kinds}"


_SEGMENTS = f"""(select conv_id::varchar as path, * from conversations
      where conv_id % 11 = 0 or conv_id % 7 = 0 or turn * 50 < least(400 - conv_id % 5 * 75, 150))"""

_CTES = {
    "cat": f"""
      select doc_id as scan_seq, {_FOLDER} || '/' || doc_id as parent, source || {_KIND} as filename,
             n_chars as length, text from documents""",
    "flat": f"""
      select doc_id as scan_seq, {_FOLDER} as parent, doc_id || '_' || source || {_KIND} as filename,
             n_chars as length from documents""",
    "files": f"""
      select parent || '/' || filename as path, *, lower({_ext('filename')}) as ext,
             {_category(f"lower({_ext('filename')})")} as category from cat""",
    "lib": f"""
      select {_FOLDER} || '/' || doc_id || '/' || source || '.md' as path, source || '.md' as filename,
             doc_id as scan_seq, 'Documents' as category, text from documents""",
    "lex": f"select * from (values {_LEX}) as v(token, lemma, tag, is_stop)",
    "lib_texts": f"select path, {_preview('text')} as preview from lib",
    "doc_texts": r"""
      select path, category, case when path like '%.txt' or path like '%.csv' then substring(text, 1, 5000) else text end as text
      from files""",
    "pieces": f"""
      select f.path, 0 as part, c.conv_id as a, c.turn as b, c.text from files f join conversations c on f.scan_seq = {_owner(4, 2)}
      union all
      select f.path, 0, c.conv_id, c.turn, c.text from files f join {_SEGMENTS} c on f.scan_seq = {_owner(6, 2)}
      union all
      select f.path, (turn > 0)::int, case when turn = 0 then c.conv_id else c.conv_id * 2 + turn % 2 end, c.turn, c.text
      from files f join conversations c on f.scan_seq = {_owner(15, 1)}""",
    "cat_texts": f"""
      select f.path, f.category, coalesce(d.preview, p.preview, '') as preview
      from files f
      left join (select path, {_preview('text')} as preview from doc_texts
                 where category = 'Documents' and path not like '%.pptx') d using (path)
      left join ({_assembled('pieces', 'part, a, b')}) p using (path)
      where f.category in ('Documents', 'Images', 'Audio', 'Video')""",
    "toks": _tokens_of("lib_texts", "path", "preview"),
    "looked": _lookup("toks"),
    "kept": f"""
      select * from looked where tag in ({_quoted(KEYWORD_TAGS)}) and not is_stop and length(text) > 2
        and lemma not in ({_quoted(GENERIC_WORDS)})""",
    "kws": _keywords_of("lib_texts"),
    "all_texts": f"""
      select path, preview from cat_texts where preview <> ''
      union all
      select path, {_preview('text')} from doc_texts where category not in ('Documents', 'Images', 'Audio', 'Video')""",
    "cat_kws": _keywords_of("all_texts"),
    "strings": """
      select l.path, coalesce(k.s, '') as keywords from lib l
      left join (select path, string_agg(keyword, ', ' order by rank) as s from kws group by path) k using (path)""",
    "sentences": r"""
      select conv_id || '-' || turn as query_id, text from conversations""",
    "found": f"""
      select query_id, row_number() over (partition by query_id order by pos) - 1 as idx, text as label
      from ({_lookup(f"({_tokens_of('sentences', 'query_id', 'text')})")})
      where tag in ('NOUN', 'PROPN') and not is_stop""",
    "targets": f"""
      select row_number() over (order by pos) - 1 as idx, text as label
      from ({_lookup(f"({_tokens_of(chr(40) + 'select 0 as q, ' + repr(SENTENCE) + ' as s' + chr(41), 'q', 's')})")})
      where tag in ('NOUN', 'PROPN') and not is_stop""",
    "vecs": "select vec_id, embedding::double[] as vec from embeddings",
    "scored": f"""
      select v.vec_id, t.idx, t.label,
             list_dot_product(v.vec, t.vec) / ({_norm('v.vec')} * {_norm('t.vec')}) as score
      from vecs v cross join
           (select idx, label, vec from {_keyed('targets', 'label')} join vecs using (vec_id)) t""",
    "present": "select * from files where scan_seq not in (select doc_id from labels where toxic = 1)",
    "plan": _planned("files", "present"),
    "clean": _planned("files", "files"),
    "dst": """
      select dest_path as path, length + case when path like '/in/es/%' then 1 else 0 end as length from plan
      where status = 'planned' and scan_seq not in (select doc_id from labels where quality = 0)""",
    "src": "select * from present where parent not like '/in/fr/sub/%'",
    "checked": """
      select p.path, p.dest_path, s.length as src_len, d.length as dst_len,
             case when d.length is null then 'missing' when s.length is null then 'error'
                  when s.length <> d.length then 'size_mismatch' else 'ok' end as status
      from plan p left join dst d on d.path = p.dest_path left join src s on s.path = p.path
      where p.status = 'planned'""",
    "checked_clean": "select path, dest_path, length as src_len, length as dst_len, 'ok' as status from clean",
    "gates": """
      select 'damaged' as run, (select coalesce(bool_and(status = 'ok'), true) from checked)
             and (select count(*) from plan where status <> 'planned') = 0 as passed
      union all
      select 'clean', (select coalesce(bool_and(status = 'ok'), true) from checked_clean)
             and (select count(*) from clean where status <> 'planned') = 0""",
    "retired": """
      select 'damaged' as run, path from plan where status = 'planned' and path in (select path from src)
        and (select passed from gates where run = 'damaged')
      union all
      select 'clean', path from clean where (select passed from gates where run = 'clean')""",
}
_WITH = "with " + ",\n".join(f"{name} as ({body})" for name, body in _CTES.items()) + "\n"


def _summary(run: str, plan: str, checked: str) -> str:
    return f"""
      select '{run}' as run, count(*) as processed, count(*) filter (status = 'planned') as copied,
             count(*) filter (status <> 'planned') as copy_errors,
             (select count(*) from {checked} where status = 'ok') as verified,
             (select count(*) from {checked} where status <> 'ok') as failed_verifications,
             (select count(*) from retired where run = '{run}') as retired,
             (select passed from gates where run = '{run}') as originals_retired
      from {plan}"""


_SPLIT = rf"""
  select path, filename, left(filename, length(filename) - length({_ext('filename')})) as stem, lower({_ext('filename')}) as ext
  from (select path, filename from files union all
        select url, regexp_extract(url, '[^/]*$', 0) from pages)"""
_BASE = "regexp_extract(url, '[^/]*$', 0)"
_PARENT = f"left(url, length(url) - length({_BASE}) - 1)"
_FILE_COLUMNS = "parent || '/' || filename as path, filename, parent, length, scan_seq"

_SELECTS = {
    "scan_totals": "select count(*) as n_files, coalesce(sum(length), 0)::bigint as n_bytes from files",
    "scan_recursive": f"select {_FILE_COLUMNS} from flat where parent || '/' like '/in/en/%'",
    "scan_top_level": f"select {_FILE_COLUMNS} from flat where parent = '/in/en'",
    "split_extension": _SPLIT,
    "path_parts": f"""
      select page_id, {_PARENT} as parent, {_BASE} as filename,
             '/mirror/' || regexp_extract({_PARENT}, '[^/]*$', 0) || '/' || {_BASE} as joined from pages""",
    "classify_by_extension": "select path, filename, ext, category from files",
    "category_breakdown": "select category, count(*) as n_files from files group by category",
    "text_bearing": "select path, category from files where category in ('Documents', 'Images', 'Audio', 'Video')",
    "keyword_eligible": "select path, category from cat_texts where preview <> '' and category <> 'Others'",
    "text_prefix": "select doc_id, substring(text, 1, 5000) as prefix from documents",
    "word_preview": r"select path, preview, len(regexp_extract_all(preview, '[^ ]+')) as n_words from lib_texts",
    "attach_extracted_text": """
      select path, category, case when category = 'Documents' and path not like '%.txt' and path not like '%.csv'
                                  then text else '' end as text from doc_texts""",
    "assemble_ocr_text": _assembled("(select conv_id::varchar as path, turn, text from conversations)", "turn"),
    "assemble_slide_text": _assembled(
        "(select conv_id::varchar as path, turn, text from conversations)",
        "case when turn = 0 then 0 else 1 end, turn % 2, turn",
    ),
    "assemble_transcript": _assembled(_SEGMENTS, "turn"),
    "dispatch_text": "select path, category, preview from cat_texts",
    "tokens": "select path, pos, text from toks",
    "lexicon_lookup": "select path, pos, text, lemma, tag, is_stop from looked",
    "token_filter": "select path, pos, text, lemma, tag, is_stop from kept",
    "term_frequency": "select path, lemma, count(*) as n, min(pos) as first_pos from kept group by path, lemma",
    "top_keywords": "select path, rank, keyword, n, first_pos from kws",
    "keyword_string": "select path, keywords from strings",
    "parse_keywords": """
      select path, unnest(range(len(k))) as pos, unnest(k) as keyword from (
        select path, list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)), lambda x: x <> '') as k
        from strings)""",
    "query_targets": "select query_id, idx, label from found",
    "capitalise_label": """
      select query_id, idx, label,
             case label[1] when 'ß' then 'Ss' else upper(label[1]) end || lower(label[2:]) as category from found""",
    "choose_branch": r"""
      select query_id, case when regexp_full_match(text, '\s*') then 'keep' else 'match' end as branch from sentences
      union all select distinct conv_id || '-blank', 'keep' from conversations""",
    "attach_target_vectors": f"""
      select query_id, idx, label, len(vec) as n_dims, round({_norm('vec')}, 6) as norm
      from {_keyed('found', 'label')} join vecs using (vec_id)""",
    "attach_keyword_vectors": f"""
      select keyword, len(vec) as n_dims, round({_norm('vec')}, 6) as norm
      from {_keyed('(select distinct keyword from kws)', 'keyword')} join vecs using (vec_id)""",
    "pairwise_cosine": f"""
      select keyword as term, idx, label, round(score, 9) as score
      from {_keyed('(select distinct keyword from kws)', 'keyword')} join scored using (vec_id) where score > 0.45""",
    "best_score": f"select path, round(score, 9) as score from ({_matches('kws')})",
    "best_target": f"select path, idx, label from ({_matches('kws')})",
    "match_sentences": f"""
      select query_id, idx, label, count(*) as n_files, round(max(score), 9) as best, min(path) as first_path
      from (select query_id, path, max(score) as score, arg_max(label, (score, -idx)) as label, arg_max(idx, (score, -idx)) as idx
            from (select distinct path, vec_id from {_keyed('kws', 'keyword')})
            join (select a.vec_id, b.vec_id as target, list_dot_product(a.vec, b.vec) / ({_norm('a.vec')} * {_norm('b.vec')}) as score
                  from vecs a cross join vecs b where score > 0.45) using (vec_id)
            join (select query_id, idx, label, vec_id as target from {_keyed('found', 'label')}) using (target)
            group by query_id, path)
      group by all""",
    "match_categories": f"""
      select path, ext_category, category, round(score, 9) as score from ({_categorised('files', 'cat_kws')})""",
    "organise_with_query": f"""
      select path, ext_category, category, round(score, 9) as score from ({_categorised('lib', 'kws')})""",
    "organise_with_model": f"""
      select l.path, l.category as ext_category,
             case when m.score > 0.45 then upper(m.label[1]) || lower(m.label[2:]) else l.category end as category,
             case when m.score > 0.45 then round(m.score, 9) end as score
      from lib l left join (
        select path, max(score) as score, arg_max(label, (score, -idx)) as label
        from (select path, idx, label, list_dot_product(k.vec, t.vec) / ({_norm('k.vec')} * {_norm('t.vec')}) as score
              from (select path, {_toy('keyword')} as vec from kws) k cross join (select idx, label, {_toy('label')} as vec from targets) t)
        group by path) m using (path)""",
    "organise_no_query": "select path, category, dest_path, n_suffix, status from clean",
    "organise_layout": f"""
      select path, category, '{DEST}/' || category || '/' || {_numbered('filename', 'k')} as dest_path, k as n_suffix, 'planned' as status
      from (select *, row_number() over (partition by category, filename order by scan_seq) - 1 as k
            from ({_categorised('files', 'cat_kws')}))""",
    "destination_paths": f"select path, category, '{DEST}/' || category || '/' || filename as dest_path from files",
    "missing_sources": "select path from files where path not in (select path from present)",
    "copy_status": "select status, count(*) as n_files from plan group by status",
    "collision_suffix": f"""
      select path, category, {_numbered('filename', 'n_suffix')} as target, n_suffix from clean""",
    "collision_existing": f"""
      select path, category, {_numbered('filename', 'k')} as target, k as n_suffix from (
        select c.*, c.n_suffix + (e.filename is not null)::bigint as k from clean c
        left join (select distinct category, filename from files join labels on doc_id = scan_seq where quality = 1) e
          on e.category = c.category and e.filename = c.filename)""",
    "write_layout": """
      select p.path, p.category, p.dest_path, p.length, d.text as content
      from plan p join doc_texts d using (path) where p.status = 'planned'""",
    "verify_copies": "select path, dest_path, src_len, dst_len, status from checked",
    "failed_verifications": "select path, dest_path, src_len, dst_len, status from checked where status <> 'ok'",
    "retire_gate": "select run, passed from gates",
    "retire_list": "select run, path from retired",
    "run_summary": _summary("damaged", "plan", "checked") + " union all " + _summary("clean", "clean", "checked_clean"),
}

#: One file after the other within each source, all sources side by side.
_CONTENDED = f"""
with recursive queue as (
  select {_FOLDER} || '/' || doc_id || '/' || name || '.txt' as path, source, name,
         row_number() over (partition by source order by doc_id) as i
  from (select *, source || (['', '_1', '_1_1'])[doc_id % 3 + 1] as name from documents)),
step as (
  select source, 0::bigint as i, []::varchar[] as used, null::varchar as path, null::bigint as n_suffix
  from (select distinct source from documents)
  union all
  select source, i, list_append(used, target), path, n_suffix from (
    select *, case when n_suffix = 0 then name else name || '_' || n_suffix end as target from (
      select q.source, q.i, s.used, q.path, q.name,
             list_filter(range(0, q.i + 1), lambda k: not list_contains(s.used,
               case when k = 0 then q.name else q.name || '_' || k end))[1] as n_suffix
      from step s join queue q on q.source = s.source and q.i = s.i + 1)))
select path, used[-1] || '.txt' as target, n_suffix from step where i > 0"""

_TREE = """
select parent || '/' || filename as path, filename, strlen(text)::bigint as length, text,
       row_number() over (order by parent || '/' || filename) - 1 as scan_seq
from (select doc_id || '_' || source || {kind} as filename, {folder} as parent, text from documents)""".format(kind=_KIND, folder=_FOLDER)

ORACLE: dict[str, str] = {name: _WITH + select for name, select in _SELECTS.items()}
ORACLE["collision_contended"] = _CONTENDED
ORACLE["scan_tree"] = f"select path, filename, length, scan_seq from ({_TREE})"
ORACLE["scan_tree_top"] = f"""
select path, filename, length, row_number() over (order by path) - 1 as scan_seq
from ({_TREE}) where regexp_full_match(path, '/in/en/[^/]*')"""
ORACLE["read_prefix"] = f"""
select path, substring(text, 1, 5000) as text, null::varchar as error from ({_TREE}) where path like '%.txt' or path like '%.csv'"""
ORACLE["organise_tree"] = _WITH + f"""
select path, '/out/' || category || '/' || {_numbered('filename', 'k')} as dest_path, 'copied' as status, 'ok' as verified,
       strlen(text)::bigint as dst_len, true as retired
from (select *, row_number() over (partition by category, filename order by path) - 1 as k from files)"""
ORACLE["organise_tree_with_query"] = _WITH + f"""
select path, '/out/' || category || '/' || {_numbered('filename', 'k')} as dest_path, 'copied' as status, 'ok' as verified,
       strlen(text)::bigint as dst_len, true as retired
from (select c.*, cat.text, row_number() over (partition by c.category, c.filename order by c.path) - 1 as k
      from ({_categorised('files', 'cat_kws')}) c join cat using (scan_seq))"""
ORACLE["run_progress"] = """
select unnest(['categorised', 'planned', 'verified']) as step, (select count(*) from documents) as n_rows, 0::bigint as n_failed"""
