"""DuckDB SQL fragments mirroring the Spark derivations (used by the oracle).

Each helper returns SQL text; the registered oracle queries are built from
them so that the same fixed values appear once.
"""

from __future__ import annotations

from corpusprep.functions import text as tx
from corpusprep.profiles import BASE_SPECIALS, CHAT_SPECIALS
from corpusprep.sources import tables as tb

SEED = 42
MS = "▁"
TITLE = tx.TITLE_PATTERN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h(expr: str) -> str:
    """First 15 hex digits of md5 as bigint."""
    return f"cast('0x' || substr(md5({expr}), 1, 15) as bigint)"


def h_seed(key: str, seed: int = SEED) -> str:
    return h(f"'{seed}:' || cast({key} as varchar)")


def metaspace(t: str) -> str:
    r = f"replace({t}, ' ', '{MS}')"
    return f"(case when starts_with({r}, '{MS}') then {r} else '{MS}' || {r} end)"


def pieces(t: str) -> str:
    return (f"(case when {t} = '' then []::varchar[] else "
            f"string_split(replace({metaspace(t)}, '{MS}', chr(1) || '{MS}'), chr(1))[2:] end)")


def pieces_with_specials(t: str, specials) -> str:
    alts = "|".join(s.replace("[", r"\[").replace("]", r"\]").replace("/", "/")
                    for s in sorted(specials, key=len, reverse=True))
    marked = f"regexp_replace({t}, '({alts})', chr(1) || '\\1' || chr(1), 'g')"
    segs = f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"
    sp = "[" + ", ".join(q(s) for s in specials) + "]"
    return (f"flatten(list_transform({segs}, lambda s: case when list_contains({sp}, s) "
            f"then [s] else {pieces('s')} end))")


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"


def text_table() -> str:
    return "select lang as dataset, doc_id, source, text from documents"


def split_exact(n_holdout: int = 20, by: str = "dataset") -> str:
    """R2 per dataset: rn over (h, doc_id); <= n/2 validation, <= n test."""
    nv = n_holdout // 2
    return (f"select *, case when rn <= {nv} then 'validation' when rn <= {n_holdout} then 'test' "
            f"else 'train' end as split from (select *, row_number() over (partition by {by} "
            f"order by {h_seed('doc_id')}, doc_id) as rn from ({text_table()}))")


def word_vocab(vocab_size: int = 32000, source: str = "documents", specials=BASE_SPECIALS) -> str:
    """V3 over every row of ``source`` (must have ``text``): id = k + rank."""
    k = len(specials)
    sp = ", ".join(q(s) for s in specials)
    spec_rows = " union all ".join(f"select {i} as id, {q(s)} as piece" for i, s in enumerate(specials))
    return (f"select id, piece from (select cast({k - 1} + row_number() over (order by freq desc, piece) "
            f"as integer) as id, piece from (select piece, count(*) as freq from (select unnest({pieces('text')}) "
            f"as piece from {source}) where piece not in ({sp}) group by piece) "
            f"qualify row_number() over (order by freq desc, piece) <= {vocab_size - k}) "
            f"union all {spec_rows}")


def extended_vocab(base: str, specials=CHAT_SPECIALS) -> str:
    """V5: missing specials get max(id)+1.. in list order."""
    rows = " union all ".join(f"select {i} as ord, {q(s)} as piece" for i, s in enumerate(specials))
    return (f"select id, piece from ({base}) union all "
            f"select cast((select max(id) from ({base})) + row_number() over (order by ord) as integer) as id, piece "
            f"from ({rows}) s where piece not in (select piece from ({base}))")


def wiki_lines() -> str:
    st = tb.WIKI_LINE_STRIDE
    return (f"select doc_id * {st} as pos, ' = Doc ' || cast(doc_id as varchar) || ' = ' || chr(10) as text from documents "
            f"union all select doc_id * {st} + 1, ' ' || chr(10) from documents "
            f"union all select doc_id * {st} + 1 + j, line || chr(10) from "
            f"(select doc_id, unnest(string_split(text, chr(10))) as line, "
            f"generate_subscripts(string_split(text, chr(10)), 1) as j from documents)")


def books() -> str:
    return (f"select doc_id as book_id, 'Doc ' || cast(doc_id as varchar) as title_src, "
            f"case when doc_id % {tb.BOOK_AUTHOR_NULL_MOD} = 0 then null else source end as author_src, "
            f"cast({tb.BOOK_YEAR_BASE} + doc_id % 100 as varchar) as date1_src, "
            f"string_split(text, chr(10)) as text_by_page_src, cast(len({words('text')}) as integer) as token_count "
            f"from documents")


def instructions() -> str:
    return ("select conv_id as id, coalesce(sys, usr) as instruction, case when sys is not null then usr end as input, "
            "output from (select conv_id, arg_min(text, turn) filter (where role = 'system') as sys, "
            "arg_min(text, turn) filter (where role = 'user') as usr, "
            "arg_min(text, turn) filter (where role = 'assistant') as output from conversations group by conv_id) "
            "where output is not null")


def sft_rows() -> str:
    return ("select id, '<SYSTEM>' || instruction || '</SYSTEM>' || case when length(input) > 0 then "
            "'<USER>' || input || '</USER>' else '' end || '<MODEL>' as prompt, output || '</MODEL>' as completion "
            f"from ({instructions()})")


def messages() -> str:
    g, rm = tb.MESSAGE_GROUP, tb.RANK_MOD
    base = ("select conv_id, role, text, row_number() over (partition by conv_id order by turn) - 1 as t "
            "from conversations where role <> 'system'")
    att = f"case when conv_id % {g} = 0 then 0 when conv_id % {g} = 3 then 2 else 1 end"
    m = (f"select cast(conv_id as varchar) || '-' || cast(t as varchar) as message_id, "
         f"case when conv_id % {g} = 0 and t = 0 then null "
         f"when conv_id % {g} > 0 and t = {att} then cast((conv_id // {g}) * {g} as varchar) || '-' || cast({att} - 1 as varchar) "
         f"else cast(conv_id as varchar) || '-' || cast(t - 1 as varchar) end as parent_id, "
         f"case when role = 'user' then 'prompter' when role = 'assistant' then 'assistant' else role end as role, text "
         f"from ({base}) where conv_id % {g} = 0 or t >= {att}")
    return (f"select *, cast(case when {h('message_id')} % {rm} = {rm - 1} then null "
            f"else {h('message_id')} % {rm} end as integer) as rank from ({m})")


def metrics() -> str:
    return ("select user_id as run, event_type as tag, row_number() over (partition by user_id order by ts, event_id) "
            "as step, ts, value from events")


def candidates() -> str:
    return ("select vec_id as group_id, cast(generate_subscripts(embedding, 1) - 1 as bigint) as item_id, "
            "cast(unnest(embedding) as double) as score from embeddings")


def kids() -> str:
    """Children with sibling rank rn (1 = best) and the fan-out."""
    return (f"select parent_id, message_id, role, text, row_number() over (partition by parent_id "
            f"order by coalesce(rank, 0), message_id) as rn, count(*) over (partition by parent_id) as n_children "
            f"from ({messages()}) where parent_id is not null and parent_id <> ''")


def tree_ctes() -> str:
    """WITH RECURSIVE prefix: m, kids, best path (root_id, message_id, depth)."""
    return (f"with recursive m as ({messages()}), k as ({kids()}), "
            "path(root_id, message_id, depth) as (select message_id, message_id, 0 from m "
            "where parent_id is null or parent_id = '' union all select p.root_id, k.message_id, p.depth + 1 "
            "from path p join k on k.parent_id = p.message_id and k.rn = 1), "
            "br as (select distinct p.root_id, p.message_id as node_id, p.depth from path p join k on k.parent_id = p.message_id "
            "where k.n_children >= 2), "
            "pr as (select br.node_id, string_agg(case when m.role = 'prompter' then '<USER>' || m.text || '</USER>' "
            "when m.role = 'assistant' then '<MODEL>' || m.text || '</MODEL>' end, '' order by x.depth) || '<MODEL>' as prompts "
            "from br join path x on x.root_id = br.root_id and x.depth <= br.depth join m on m.message_id = x.message_id "
            "group by br.node_id)")


def closure_ctes(start: str) -> str:
    return (f"with recursive m as ({messages()}), "
            f"d(root_id, message_id, depth) as (select message_id, message_id, 0 from ({start}) "
            "union all select d.root_id, m.message_id, d.depth + 1 from d join m on m.parent_id = d.message_id)")


ALL_SPECIALS = BASE_SPECIALS + CHAT_SPECIALS


def seq_long(rows_sql: str, vocab_sql: str, extra: str = "") -> str:
    """Long form (row_id, which, pos, id) of T3 for rows (row_id, p, c):
    full = ids(p) + ids(c); input_ids = full[:-1]; labels = ([-100]*|p| + ids(c))[1:].
    ``extra`` is a constant column list prefix (e.g. "0 as sub, ")."""
    P = pieces_with_specials("p", ALL_SPECIALS)
    C = pieces_with_specials("c", ALL_SPECIALS)
    return (f"(with r as ({rows_sql}), v as (select id as vid, piece from ({vocab_sql})), "
            f"pp as (select row_id, unnest({P}) as piece, generate_subscripts({P}, 1) as i, len({P}) + len({C}) as n from r), "
            f"cc as (select row_id, unnest({C}) as piece, generate_subscripts({C}, 1) as i, len({P}) as np, len({P}) + len({C}) as n from r), "
            "f as (select row_id, i as k, coalesce(vid, 0) as tok, -100 as lab, n from pp left join v using (piece) "
            "union all select row_id, np + i, coalesce(vid, 0), coalesce(vid, 0), n from cc left join v using (piece)) "
            f"select row_id, {extra}'input_ids' as which, cast(k - 1 as bigint) as pos, cast(tok as bigint) as id from f where k <= n - 1 "
            f"union all select row_id, {extra}'labels', cast(k - 2 as bigint), cast(lab as bigint) from f where k >= 2)")


def script_pattern(lead: str = "", space: str = r"\s") -> str:
    """Runs of one script, single digits and runs of marks."""
    runs = [r"\p{Latin}+", r"\p{L}+", r"\p{N}", rf"[^\p{{L}}\p{{N}}{space}]+"]
    other = [rf"\p{{{s}}}+" for s in tx.SCRIPTS] + [r"[\p{Han}\p{Hiragana}\p{Katakana}" + tx.LONG_VOWEL + "]+"]
    return "|".join(lead + r for r in [runs[0], *other, *runs[1:]])
