"""Registered queries over the driver tables, each with its DuckDB oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame``; ``ORACLE[name] = sql``.
Array results are emitted in long form (key, pos, value) so that the oracle
compares scalars. Names carry the operator ID of the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators import segment, split, stats, tokenise, vocab
from corpusprep.plans import sqlparts as S
from corpusprep.profiles import BASE_SPECIALS, CHAT_SPECIALS
from corpusprep.session import reliable_checkpoint
from corpusprep.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42
N_HOLDOUT = 20          # per dataset: 10 validation + 10 test
VOCAB_SIZE = 32000      # word vocabulary incl. the four base specials
CHUNK_WORDS = 50


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------
# shared Spark building blocks
# --------------------------------------------------------------------------

def split_text(spark, sf):
    return split.split_exact(tb.text_table(spark, sf), "doc_id", N_HOLDOUT, SEED, by="dataset")


def word_vocab(spark, sf):
    return vocab.train_word_vocab(tb.text_table(spark, sf), VOCAB_SIZE, BASE_SPECIALS)


def chat_vocab(spark, sf):
    return vocab.extend_vocab(word_vocab(spark, sf), CHAT_SPECIALS)


def long_ids(df: DataFrame, key: str, col: str = "input_ids") -> DataFrame:
    return df.select(key, F.posexplode(col).alias("pos", "id")).select(
        key, F.col("pos").cast("long"), F.col("id").cast("long"))


# --------------------------------------------------------------------------
# flagship: tokens per dataset and split (+ grand total)
# --------------------------------------------------------------------------

_NTOK = f"(len({S.pieces('text')}) + 2)"
_SPLIT = S.split_exact(N_HOLDOUT)


@register("a2_token_stats_total",
          f"with n as (select dataset, split, cast({_NTOK} as bigint) as ntok from ({_SPLIT})) "
          "select dataset, split, cast(sum(ntok) as bigint) as total_tokens, count(*) as examples, "
          "round(sum(ntok) / count(*), 6) as avg_tokens from n group by dataset, split "
          "union all select 'ALL', 'ALL', cast(sum(ntok) as bigint), count(*), round(sum(ntok) / count(*), 6) from n")
def a2_token_stats_total(spark, sf):
    t = split_text(spark, sf)
    v = vocab.train_word_vocab(t.filter(F.col("split") == "train"), VOCAB_SIZE, BASE_SPECIALS)
    tok = tokenise.tokenize_pretrain(t.select("dataset", "split", "text"), v)
    return stats.token_stats_total(tok)


@register("a1_token_stats",
          f"select dataset, split, cast(sum({_NTOK}) as bigint) as total_tokens, count(*) as examples, "
          f"round(sum({_NTOK}) / count(*), 6) as avg_tokens from ({_SPLIT}) group by dataset, split")
def a1_token_stats(spark, sf):
    t = split_text(spark, sf)
    v = word_vocab(spark, sf)
    return stats.token_stats(tokenise.tokenize_pretrain(t.select("dataset", "split", "text"), v))


@register("r2_split_exact", f"select dataset, doc_id, split from ({_SPLIT})")
def r2_split_exact(spark, sf):
    return split_text(spark, sf).select("dataset", "doc_id", "split")


@register("a10_dataset_sizes",
          f"select dataset, split, count(*) as rows from ({_SPLIT}) group by dataset, split")
def a10_dataset_sizes(spark, sf):
    return stats.dataset_sizes(split_text(spark, sf))


@register("a3_count_tokens",
          f"select split, cast(sum({_NTOK}) as bigint) as tokens from ({_SPLIT}) group by split "
          f"union all select 'ALL', cast(sum({_NTOK}) as bigint) from ({_SPLIT})")
def a3_count_tokens(spark, sf):
    t = split_text(spark, sf)
    return stats.count_tokens(tokenise.tokenize_pretrain(t.select("split", "text"), word_vocab(spark, sf)))


# --------------------------------------------------------------------------
# vocabulary
# --------------------------------------------------------------------------

@register("a6_word_counts",
          f"select piece, count(*) as freq from (select unnest({S.pieces('text')}) as piece from documents) group by piece")
def a6_word_counts(spark, sf):
    return vocab.word_counts(tb.text_table(spark, sf))


@register("v3_word_vocab", S.word_vocab(VOCAB_SIZE))
def v3_word_vocab(spark, sf):
    return word_vocab(spark, sf).select("id", "piece")


@register("v5_extend_vocab", S.extended_vocab(S.word_vocab(VOCAB_SIZE)))
def v5_extend_vocab(spark, sf):
    return chat_vocab(spark, sf).select("id", "piece")


@register("u3_missing_pieces",
          "select piece from (" + " union all ".join(f"select {S.q(s)} as piece" for s in CHAT_SPECIALS + ["[PAD]"])
          + f") where piece not in (select piece from ({S.word_vocab(VOCAB_SIZE)}))")
def u3_missing_pieces(spark, sf):
    return vocab.missing_pieces(word_vocab(spark, sf), CHAT_SPECIALS + ["[PAD]"]).select("piece")


# --------------------------------------------------------------------------
# tokenisation (long form)
# --------------------------------------------------------------------------

_VOCAB_SQL = S.word_vocab(VOCAB_SIZE)


@register("t2_tokenize_pretrain",
          f"with v as ({_VOCAB_SQL}), p as (select doc_id, unnest({S.pieces('text')}) as piece, "
          f"generate_subscripts({S.pieces('text')}, 1) as pos from documents) "
          "select doc_id, cast(pos as bigint) as pos, cast(coalesce(v.id, 0) as bigint) as id "
          "from p left join v using (piece) "
          "union all select doc_id, 0, 2 from documents "
          f"union all select doc_id, cast(len({S.pieces('text')}) + 1 as bigint), 3 from documents")
def t2_tokenize_pretrain(spark, sf):
    t = tb.text_table(spark, sf).select("doc_id", "text")
    return long_ids(tokenise.tokenize_pretrain(t, word_vocab(spark, sf)), "doc_id")


@register("j4_vocab_lookup_join",
          f"with v as ({_VOCAB_SQL}), p as (select doc_id, unnest({S.pieces('text')}) as piece, "
          f"generate_subscripts({S.pieces('text')}, 1) - 1 as pos from documents) "
          "select doc_id, cast(pos as bigint) as pos, cast(coalesce(v.id, 0) as bigint) as id "
          "from p left join v using (piece)")
def j4_vocab_lookup_join(spark, sf):
    t = tb.text_table(spark, sf)
    return tokenise.encode_long(t, word_vocab(spark, sf), "doc_id")


# --------------------------------------------------------------------------
# string scalars
# --------------------------------------------------------------------------

@register("c1_clean_whitespace",
          r"select doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') as text from documents")
def c1_clean_whitespace(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_whitespace("text").alias("text"))


@register("c5_metaspace_pieces",
          f"select doc_id, cast(generate_subscripts({S.pieces('text')}, 1) - 1 as bigint) as pos, "
          f"unnest({S.pieces('text')}) as piece from documents")
def c5_metaspace_pieces(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return (d.select("doc_id", F.posexplode(tx.metaspace_pieces(F.col("text"))).alias("pos", "piece"))
            .select("doc_id", F.col("pos").cast("long"), "piece"))


@register("x1_chunk_words",
          f"select doc_id, cast(i // {CHUNK_WORDS} as bigint) as chunk, array_to_string(w[i + 1 : i + {CHUNK_WORDS}], ' ') as text "
          f"from (select doc_id, w, unnest(generate_series(0, len(w) - 1, {CHUNK_WORDS})) as i "
          f"from (select doc_id, {S.words('text')} as w from documents) where len(w) > 0)")
def x1_chunk_words(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return (d.select("doc_id", F.posexplode(tx.chunk_words(F.col("text"), CHUNK_WORDS)).alias("chunk", "text"))
            .select("doc_id", F.col("chunk").cast("long"), "text"))


@register("c2_drop_blank_lines",
          r"select pos, text from (" + S.wiki_lines() + r") where regexp_replace(text, '\s', '', 'g') <> ''")
def c2_drop_blank_lines(spark, sf):
    return tb.wiki_lines(spark, sf).filter(~tx.is_blank("text"))


@register("r10_is_title",
          f"select pos, text from ({S.wiki_lines()}) where regexp_matches(text, '{S.TITLE}')")
def r10_is_title(spark, sf):
    return tb.wiki_lines(spark, sf).filter(tx.is_title("text"))


# --------------------------------------------------------------------------
# articles
# --------------------------------------------------------------------------

_ART = (f"select pos, text, sum(case when regexp_matches(text, '{S.TITLE}') then 1 else 0 end) "
        f"over (order by pos rows between unbounded preceding and current row) as article_id from ({S.wiki_lines()})")


@register("w1_article_id", f"select pos, cast(article_id as bigint) as article_id from ({_ART})")
def w1_article_id(spark, sf):
    return segment.article_ids(tb.placed_wiki_lines(spark, sf), tb.WIKI_ORDER).select("pos", "article_id")


@register("a4_coalesce_articles",
          rf"select cast(article_id as bigint) as article_id, regexp_replace(string_agg(text, '' order by pos), '^\s+|\s+$', '', 'g') as text "
          rf"from ({_ART}) where regexp_replace(text, '\s', '', 'g') <> '' group by article_id")
def a4_coalesce_articles(spark, sf):
    return segment.coalesce_articles(tb.placed_wiki_lines(spark, sf), tb.WIKI_ORDER)


# --------------------------------------------------------------------------
# books and instructions
# --------------------------------------------------------------------------

@register("p2_book_text",
          "select book_id, coalesce(title_src, 'None') || ' by ' || coalesce(author_src, 'None') || ', published ' || "
          "coalesce(date1_src, 'None') || chr(10) || array_to_string(text_by_page_src, '') as text, token_count "
          f"from ({S.books()})")
def p2_book_text(spark, sf):
    b = tb.books(spark, sf)
    return b.select("book_id", tx.book_text("title_src", "author_src", "date1_src", "text_by_page_src")
                    .alias("text"), "token_count")


@register("p3_format_instruction", f"select id, prompt, completion from ({S.sft_rows()})")
def p3_format_instruction(spark, sf):
    i = tb.instructions(spark, sf)
    p, c = tx.format_instruction("instruction", "input", "output")
    return i.select("id", p.alias("prompt"), c.alias("completion"))


# --------------------------------------------------------------------------
# conversation forest
# --------------------------------------------------------------------------

from corpusprep.operators import tree  # noqa: E402

N_TEST_ROOTS = 5


@register("g1_roots", f"select message_id from ({S.messages()}) where parent_id is null or parent_id = ''")
def g1_roots(spark, sf):
    return tree.roots(tb.messages(spark, sf)).select("message_id")


@register("w2_rank_children",
          f"select parent_id, message_id, cast(rn as bigint) as rn, cast(n_children as bigint) as n_children from ({S.kids()})")
def w2_rank_children(spark, sf):
    return tree.rank_children(tb.messages(spark, sf)).select(
        "parent_id", "message_id", F.col("rn").cast("long"), F.col("n_children").cast("long"))


@register("a5_children_of",
          f"select parent_id, string_agg(message_id, ',' order by rn) as children from ({S.kids()}) group by parent_id")
def a5_children_of(spark, sf):
    return tree.children_of(tb.messages(spark, sf)).select(
        "parent_id", F.array_join("children", ",").alias("children"))


@register("g3_descendants",
          S.closure_ctes("select message_id from m where parent_id is null or parent_id = ''")
          + " select root_id, message_id, cast(depth as bigint) as depth from d")
def g3_descendants(spark, sf):
    m = tb.messages(spark, sf)
    return tree.descendants(m, tree.roots(m)).select("root_id", "message_id", F.col("depth").cast("long"))


@register("g4_best_path", S.tree_ctes() + " select root_id, message_id, cast(depth as bigint) as depth from path")
def g4_best_path(spark, sf):
    return tree.best_path(tb.messages(spark, sf)).select("root_id", "message_id", F.col("depth").cast("long"))


@register("p4_render_context", S.tree_ctes() + " select node_id, prompts from pr")
def p4_render_context(spark, sf):
    m = tb.messages(spark, sf)
    return tree.preference_pairs(m).select("node_id", "prompts").distinct()


_PAIRS_SQL = (S.tree_ctes() + " select pr.node_id, a.message_id as accepted_id, r.message_id as rejected_id, pr.prompts, "
              "a.text || '</MODEL>' as accepted, r.text || '</MODEL>' as rejected from pr "
              "join k a on a.parent_id = pr.node_id join k r on r.parent_id = pr.node_id and a.rn < r.rn")


@register("g5_preference_pairs", _PAIRS_SQL)
def g5_preference_pairs(spark, sf):
    return tree.preference_pairs(tb.messages(spark, sf))


@register("r6_split_by_root",
          S.closure_ctes(f"select message_id from m where parent_id is null or parent_id = '' "
                         f"order by {S.h_seed('message_id')}, message_id limit {N_TEST_ROOTS}")
          + " select message_id, case when message_id in (select message_id from d) then 'test' else 'train' end as split from m")
def r6_split_by_root(spark, sf):
    return tree.split_by_root(tb.messages(spark, sf), N_TEST_ROOTS, SEED).select("message_id", "split")


# --------------------------------------------------------------------------
# post-training tokenisation (long form)
# --------------------------------------------------------------------------

from corpusprep.profiles import POST_TRAINING_V1  # noqa: E402

_CHAT_VOCAB_SQL = S.extended_vocab(S.word_vocab(VOCAB_SIZE))


def long_pairs(df: DataFrame, key: str, nested: bool = False) -> DataFrame:
    """(row_id, [sub,] which, pos, id) of input_ids / labels."""
    outs = []
    for which in ("input_ids", "labels"):
        if nested:
            x = df.select(F.col(key).alias("row_id"), F.posexplode(which).alias("sub", "_a")).select(
                "row_id", F.col("sub").cast("long"), F.posexplode("_a").alias("pos", "id"))
            outs.append(x.select("row_id", "sub", F.lit(which).alias("which"),
                                 F.col("pos").cast("long"), F.col("id").cast("long")))
        else:
            x = df.select(F.col(key).alias("row_id"), F.posexplode(which).alias("pos", "id"))
            outs.append(x.select("row_id", F.lit(which).alias("which"),
                                 F.col("pos").cast("long"), F.col("id").cast("long")))
    return outs[0].unionByName(outs[1])


@register("t3_tokenize_sft",
          "select * from " + S.seq_long(f"select id as row_id, prompt as p, completion as c from ({S.sft_rows()})",
                                        _CHAT_VOCAB_SQL))
def t3_tokenize_sft(spark, sf):
    i = tb.instructions(spark, sf)
    p, c = tx.format_instruction("instruction", "input", "output")
    rows = i.select("id", p.alias("prompt"), c.alias("completion"))
    tok = tokenise.tokenize_sft(rows, chat_vocab(spark, sf), POST_TRAINING_V1.specials)
    return long_pairs(tok, "id")


_PAIR_ROWS = (f"select node_id || '|' || accepted_id || '|' || rejected_id as row_id, prompts, accepted, rejected "
              f"from ({_PAIRS_SQL})")


@register("t4_tokenize_preference",
          "select * from " + S.seq_long(f"select row_id, prompts as p, accepted as c from ({_PAIR_ROWS})",
                                        _CHAT_VOCAB_SQL, "cast(0 as bigint) as sub, ")
          + " union all select * from " + S.seq_long(f"select row_id, prompts as p, rejected as c from ({_PAIR_ROWS})",
                                                     _CHAT_VOCAB_SQL, "cast(1 as bigint) as sub, "))
def t4_tokenize_preference(spark, sf):
    pairs = tree.preference_pairs(tb.messages(spark, sf))
    rows = pairs.select(F.concat_ws("|", "node_id", "accepted_id", "rejected_id").alias("row_id"),
                        "prompts", "accepted", "rejected")
    tok = tokenise.tokenize_preference(rows, chat_vocab(spark, sf), POST_TRAINING_V1.specials)
    return long_pairs(tok, "row_id", nested=True)


@register("p5_format_preference", f"select node_id, accepted_id, rejected_id, accepted, rejected from ({_PAIRS_SQL})")
def p5_format_preference(spark, sf):
    return tree.preference_pairs(tb.messages(spark, sf)).select(
        "node_id", "accepted_id", "rejected_id", "accepted", "rejected")


# --------------------------------------------------------------------------
# packing: offsets, blocks, next-token pairs, windows
# --------------------------------------------------------------------------

from corpusprep.operators import pack  # noqa: E402

CTX = 128
N_WINDOWS = 32
BATCH = 8

_P = S.pieces("text")
_STREAM = (f"with v as ({_VOCAB_SQL}), "
           f"lens as (select doc_id, len({_P}) + 2 as n from documents), "
           "offs as (select doc_id, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as off, n from lens), "
           f"p as (select doc_id, unnest({_P}) as piece, generate_subscripts({_P}, 1) as pos from documents), "
           "t as (select doc_id, pos, coalesce(v.id, 0) as id from p left join v using (piece) "
           "union all select doc_id, 0, 2 from documents union all select doc_id, n - 1, 3 from lens), "
           "g as (select off + pos as g, id from t join offs using (doc_id)), "
           "tot as (select sum(n) as L from lens)")


def pretrain_tokens(spark, sf):
    t = tb.text_table(spark, sf).select("doc_id", "text")
    return tokenise.tokenize_pretrain(t, word_vocab(spark, sf))


@register("w3_doc_offsets", _STREAM + " select doc_id, cast(off as bigint) as offset, cast(n as bigint) as n from offs")
def w3_doc_offsets(spark, sf):
    off = pack.doc_offsets(pretrain_tokens(spark, sf), ["doc_id"])
    return off.select("doc_id", "offset", F.size("input_ids").cast("long").alias("n"))


@register("l1_pack_blocks",
          _STREAM + f" select cast(g // {CTX} as bigint) as block_id, cast(g % {CTX} as bigint) as pos, cast(id as bigint) as id from g")
def l1_pack_blocks(spark, sf):
    blocks = pack.pack_blocks(pretrain_tokens(spark, sf), CTX, ["doc_id"])
    return long_ids(blocks, "block_id", "tokens")


@register("l2_next_token_pairs",
          _STREAM + f" select * from (select cast(g // {CTX} as bigint) as block_id, cast(g % {CTX} as bigint) as pos, "
          "cast(id as bigint) as x, cast(lead(id) over (order by g) as bigint) as y from g) where y is not null")
def l2_next_token_pairs(spark, sf):
    blocks = pack.pack_blocks(pretrain_tokens(spark, sf), CTX, ["doc_id"])
    p = pack.next_token_pairs(blocks)
    z = p.select("block_id", F.posexplode(F.arrays_zip("x", "y")).alias("pos", "z"))
    return z.select("block_id", F.col("pos").cast("long"), F.col("z.x").cast("long").alias("x"),
                    F.col("z.y").cast("long").alias("y"))


@register("l3_sample_windows",
          _STREAM + f", d as (select range as draw, {S.h_seed('range')} % ((select L from tot) - {CTX} - 1) as start "
          f"from range({N_WINDOWS})) select draw, cast(g - start as bigint) as pos, cast(id as bigint) as id "
          f"from d join g on g.g between d.start and d.start + {CTX}")
def l3_sample_windows(spark, sf):
    blocks = pack.pack_blocks(pretrain_tokens(spark, sf), CTX, ["doc_id"])
    w = pack.sample_windows(blocks, N_WINDOWS, CTX, CTX, SEED)
    full = F.concat("x", F.slice("y", -1, 1))
    return w.select("draw", F.posexplode(full).alias("pos", "id")).select(
        "draw", F.col("pos").cast("long"), F.col("id").cast("long"))


@register("a11_batches_per_epoch",
          f"select split, cast(sum({_NTOK}) as bigint) as tokens, cast(sum({_NTOK}) // {BATCH * CTX} as bigint) as batches "
          f"from ({_SPLIT}) group by split")
def a11_batches_per_epoch(spark, sf):
    t = split_text(spark, sf)
    tok = tokenise.tokenize_pretrain(t.select("split", "text"), word_vocab(spark, sf))
    return stats.batches_per_epoch_tokens(tok, BATCH, CTX)


# --------------------------------------------------------------------------
# SFT / preference views and batches
# --------------------------------------------------------------------------

SFT_CTX = 64
PAD_ID = 1
N_SFT_BATCHES = 4

_T3 = S.seq_long(f"select id as row_id, prompt as p, completion as c from ({S.sft_rows()})", _CHAT_VOCAB_SQL)


def sft_tokens(spark, sf):
    i = tb.instructions(spark, sf)
    p, c = tx.format_instruction("instruction", "input", "output")
    rows = i.select("id", p.alias("prompt"), c.alias("completion"))
    return tokenise.tokenize_sft(rows, chat_vocab(spark, sf), POST_TRAINING_V1.specials)


_FIT = (f"with t as (select * from {_T3}), n as (select row_id, which, count(*) as n from t group by row_id, which) "
        f"select row_id, which, cast(pos - greatest(n - {SFT_CTX}, 0) as bigint) as pos, id from t join n using (row_id, which) "
        f"where pos >= n - {SFT_CTX} "
        f"union all select row_id, which, cast(p as bigint), cast(case when which = 'input_ids' then {PAD_ID} else -100 end as bigint) "
        f"from (select row_id, which, unnest(generate_series(n, {SFT_CTX - 1})) as p from n where n < {SFT_CTX})")


@register("x5_fit_length", _FIT)
def x5_fit_length(spark, sf):
    tok = sft_tokens(spark, sf)
    x, y = pack.fit_length("input_ids", "labels", SFT_CTX, PAD_ID)
    return long_pairs(tok.select("id", x.alias("input_ids"), y.alias("labels")), "id")


@register("x7_prompt_and_target",
          f"with t as (select * from {_T3}), k as (select row_id, min(pos) as k from t where which = 'labels' and id <> -100 group by row_id), "
          "n as (select row_id, count(*) as n from t where which = 'labels' group by row_id), "
          "c as (select row_id, coalesce(k + 1, n) as cut from n left join k using (row_id)) "
          "select row_id, 'prompt' as which, pos, id from t join c using (row_id) where which = 'input_ids' and pos < cut "
          "union all select row_id, 'target', pos - cut, id from t join c using (row_id) where which = 'labels' and pos >= cut")
def x7_prompt_and_target(spark, sf):
    tok = sft_tokens(spark, sf)
    p, t = pack.prompt_and_target()
    v = tok.select(F.col("id").alias("row_id"), p.alias("prompt"), t.alias("target"))
    outs = [v.select("row_id", F.lit(w).alias("which"), F.posexplode(w).alias("pos", "id")) for w in ("prompt", "target")]
    return outs[0].unionByName(outs[1]).select("row_id", "which", F.col("pos").cast("long"), F.col("id").cast("long"))


@register("r9_sample_rows",
          f"with r as (select id, row_number() over (order by id) as rank from ({S.instructions()})), "
          f"d as (select range as draw, {S.h_seed('range')} % (select count(*) from r) + 1 as rank from range({N_SFT_BATCHES * BATCH})) "
          "select draw, id from d join r using (rank)")
def r9_sample_rows(spark, sf):
    from corpusprep.operators.order import global_rank
    ranked = global_rank(tb.instructions(spark, sf).select("id"), ["id"], "rank")
    return split.sample_rows(ranked, N_SFT_BATCHES * BATCH, SEED).select("draw", "id")


@register("l4_sft_batches",
          f"with r as (select id, row_number() over (order by id) as rank from ({S.instructions()})), "
          f"d as (select range as draw, {S.h_seed('range')} % (select count(*) from r) + 1 as rank from range({N_SFT_BATCHES * BATCH})), "
          f"f as ({_FIT}) select cast(draw // {BATCH} as bigint) as batch_id, cast(draw % {BATCH} as bigint) as slot, which, pos, f.id "
          "from d join r using (rank) join f on f.row_id = r.id")
def l4_sft_batches(spark, sf):
    from corpusprep.operators.order import global_rank
    ranked = global_rank(sft_tokens(spark, sf), ["id"], "rank")
    b = pack.sft_batches(ranked, N_SFT_BATCHES, BATCH, SFT_CTX, PAD_ID, SEED)
    outs = [b.select("batch_id", F.col("slot").cast("long"), F.lit(w).alias("which"),
                     F.posexplode(w).alias("pos", "id")) for w in ("input_ids", "labels")]
    return outs[0].unionByName(outs[1]).select("batch_id", "slot", "which", F.col("pos").cast("long"),
                                               F.col("id").cast("long"))


# --------------------------------------------------------------------------
# evaluation: candidate sampling reductions, cross entropy, preference loss
# --------------------------------------------------------------------------

from corpusprep.operators import evaluate as ev  # noqa: E402

TOP_K = 5
TOP_P = 0.5
BETA = 0.1

_TOPK = (f"select group_id, item_id, score from (select *, rank() over (partition by group_id order by score desc) as r "
         f"from ({S.candidates()})) where r <= {TOP_K}")
_SOFT = ("select group_id, item_id, score, e / sum(e) over (partition by group_id) as prob from "
         f"(select *, exp(score - max(score) over (partition by group_id)) as e from ({_TOPK}))")
_NUC = ("select group_id, item_id, prob / sum(prob) over (partition by group_id) as prob from "
        "(select group_id, item_id, prob, sum(prob) over (partition by group_id order by prob desc, item_id "
        f"rows between unbounded preceding and current row) - prob as before from ({_SOFT})) where before <= {TOP_P}")


def _cands(spark, sf):
    return ev.top_k_per_group(tb.candidates(spark, sf), TOP_K)


@register("w5_top_k_per_group", f"select group_id, item_id, round(score, 6) as score from ({_TOPK})")
def w5_top_k_per_group(spark, sf):
    return _cands(spark, sf).select("group_id", "item_id", F.round("score", 6).alias("score"))


@register("w6_softmax_per_group", f"select group_id, item_id, round(prob, 6) as prob from ({_SOFT})")
def w6_softmax_per_group(spark, sf):
    return ev.softmax_per_group(_cands(spark, sf)).select("group_id", "item_id", F.round("prob", 6).alias("prob"))


@register("w7_nucleus_per_group", f"select group_id, item_id, round(prob, 6) as prob from ({_NUC})")
def w7_nucleus_per_group(spark, sf):
    p = ev.nucleus_per_group(ev.softmax_per_group(_cands(spark, sf)), TOP_P)
    return p.select("group_id", "item_id", F.round("prob", 6).alias("prob"))


@register("w8_draw_per_group",
          f"with c as (select *, sum(prob) over (partition by group_id order by prob desc, item_id rows between unbounded "
          f"preceding and current row) as cum, {S.h_seed('group_id')} / 1152921504606846976.0 as u from ({_NUC})), "
          "f as (select group_id, arg_min(item_id, (-prob, item_id)) filter (where cum > u) as hit, "
          "arg_max(item_id, (-prob, item_id)) as last from c group by group_id) "
          "select c.group_id, c.item_id, round(c.prob, 6) as prob, round(ln(c.prob), 6) as logp from f join c "
          "on c.group_id = f.group_id and c.item_id = coalesce(f.hit, f.last)")
def w8_draw_per_group(spark, sf):
    p = ev.nucleus_per_group(ev.softmax_per_group(_cands(spark, sf)), TOP_P)
    d = ev.draw_per_group(p, SEED)
    return d.select("group_id", "item_id", F.round("prob", 6).alias("prob"), F.round("logp", 6).alias("logp"))


# token log-probabilities of the fitted preference sequences under two add-k
# bigram tables fitted on the pre-training stream (policy k=1, reference k=0.1)
K_POLICY, K_REFERENCE = 1.0, 0.1

_T4_ACC = S.seq_long(f"select row_id, prompts as p, accepted as c from ({_PAIR_ROWS})", _CHAT_VOCAB_SQL,
                     "cast(0 as bigint) as sub, ")
_T4_REJ = S.seq_long(f"select row_id, prompts as p, rejected as c from ({_PAIR_ROWS})", _CHAT_VOCAB_SQL,
                     "cast(1 as bigint) as sub, ")
_T4FIT = (f"with t as (select * from {_T4_ACC} union all select * from {_T4_REJ}), "
          "n as (select row_id, sub, which, count(*) as n from t group by row_id, sub, which), "
          f"f as (select row_id, sub, which, pos - greatest(n - {SFT_CTX}, 0) as pos, id from t join n using (row_id, sub, which) "
          f"where pos >= n - {SFT_CTX} union all select row_id, sub, which, p, case when which = 'input_ids' then {PAD_ID} else -100 end "
          f"from (select row_id, sub, which, unnest(generate_series(n, {SFT_CTX - 1})) as p from n where n < {SFT_CTX})) "
          "select i.row_id as pair_id, i.sub as which, i.pos, i.id as prev, l.id as label from f i join f l "
          "on i.row_id = l.row_id and i.sub = l.sub and i.pos = l.pos and i.which = 'input_ids' and l.which = 'labels'")
_BIGRAM = (_STREAM + ", bg as (select a.id as prev, b.id as token, count(*) as n from t a join t b on a.doc_id = b.doc_id "
           "and b.pos = a.pos + 1 group by 1, 2), bt as (select prev, sum(n) as n_prev from bg group by prev)")
_VSIZE = f"(select count(*) from ({_CHAT_VOCAB_SQL}))"


def _scored_sql(k: float, model: str) -> str:
    return (f"select pair_id, which, '{model}' as model, cast(pos as bigint) as pos, cast(label as bigint) as label, "
            f"case when label = -100 then 0.0 else ln((coalesce(bg.n, 0) + {k}) / (coalesce(bt.n_prev, 0) + {k} * {_VSIZE})) end as logp "
            "from s left join bg on bg.prev = s.prev and bg.token = s.label left join bt on bt.prev = s.prev")


_SCORES = (_BIGRAM + f", s as ({_T4FIT}), sc as ({_scored_sql(K_POLICY, 'policy')} union all "
           f"{_scored_sql(K_REFERENCE, 'reference')})")


def _scores(spark, sf):
    cv = chat_vocab(spark, sf)
    v_size = cv.count()
    pairs = tree.preference_pairs(tb.messages(spark, sf))
    rows = pairs.select(F.concat_ws("|", "node_id", "accepted_id", "rejected_id").alias("row_id"),
                        "prompts", "accepted", "rejected")
    tok = tokenise.tokenize_preference(rows, cv, POST_TRAINING_V1.specials)
    seqs = pack.explode_pairs(tok, "row_id")
    x, y = pack.fit_length("input_ids", "labels", SFT_CTX, PAD_ID)
    seqs = seqs.select(F.col("row_id").alias("pair_id"), F.col("sub").cast("long").alias("which"),
                       x.alias("input_ids"), y.alias("labels"))
    # the sequences meet the counts in two places: neither is made twice
    seqs = reliable_checkpoint(seqs)
    bg = reliable_checkpoint(ev.fit_bigram(pretrain_tokens(spark, sf)))
    return ev.score_tokens(seqs, bg, v_size, {"policy": K_POLICY, "reference": K_REFERENCE})


@register("e2_score_completions",
          _SCORES + " select pair_id, which, model, pos, label, round(logp, 6) as logp from sc")
def e2_score_completions(spark, sf):
    return _scores(spark, sf).withColumn("logp", F.round("logp", 6))


@register("e1_masked_cross_entropy",
          _SCORES + " select model, count(*) filter (where label <> -100) as tokens, "
          "round(sum(-logp) filter (where label <> -100) / count(*) filter (where label <> -100), 6) as cross_entropy, "
          "round(exp(sum(-logp) filter (where label <> -100) / count(*) filter (where label <> -100)), 6) as perplexity "
          "from sc group by model")
def e1_masked_cross_entropy(spark, sf):
    return ev.masked_cross_entropy(_scores(spark, sf))


@register("e3_preference_loss",
          _SCORES + f", d as (select pair_id, pos, {BETA} * sum(case when model = 'reference' and which = 0 then -logp "
          "when model = 'policy' and which = 0 then logp when model = 'reference' and which = 1 then logp "
          "else -logp end) as margin from sc group by pair_id, pos) "
          "select pair_id, round(avg(ln(1 + exp(-margin))), 6) as loss, round(avg(margin), 6) as reward from d group by pair_id")
def e3_preference_loss(spark, sf):
    return ev.preference_loss(_scores(spark, sf), BETA, "position")


@register("e3_preference_loss_sequence",
          _SCORES + ", q as (select pair_id, which, sum(case when model = 'policy' then -logp else 0 end) as th, "
          "sum(case when model = 'reference' then -logp else 0 end) as rf from sc group by pair_id, which) "
          f"select w.pair_id, round(ln(1 + exp(-({BETA} * ((w.rf - w.th) - (l.rf - l.th))))), 6) as loss, "
          f"round({BETA} * ((w.rf - w.th) - (l.rf - l.th)), 6) as reward from q w join q l on w.pair_id = l.pair_id "
          "and w.which = 0 and l.which = 1")
def e3_preference_loss_sequence(spark, sf):
    return ev.preference_loss(_scores(spark, sf), BETA, "sequence")


# --------------------------------------------------------------------------
# metrics log
# --------------------------------------------------------------------------

_METRICS = S.metrics()


@register("w4_throughput",
          "select run, cast(step as bigint) as step, round(case when gap > 0 then 1.0 / gap else 0.0 end, 6) as rate from "
          "(select run, step, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by run order by step) as gap "
          f"from ({_METRICS}))")
def w4_throughput(spark, sf):
    return stats.throughput(tb.metrics(spark, sf)).select("run", F.col("step").cast("long"), "rate")


@register("x10_dict_to_long",
          f"select run, cast(step as bigint) as step, 'event/' || sub as tag, v as value from (select run, step, "
          f"unnest(['value', 'step']) as sub, unnest([value, cast(step as double)]) as v from ({_METRICS}))")
def x10_dict_to_long(spark, sf):
    m = tb.metrics(spark, sf).select("run", F.col("step").cast("long").alias("step"), "value",
                                     F.col("step").cast("double").alias("step_v"))
    out = stats.dict_to_long(m.withColumnRenamed("step_v", "step_"), "event", ["value", "step_"])
    return out.withColumn("tag", F.regexp_replace("tag", "step_$", "step"))


@register("a8_mean_metric",
          f"select tag, round(avg(value), 6) as mean_value, count(*) as batches from ({_METRICS}) group by tag")
def a8_mean_metric(spark, sf):
    return stats.mean_metric(tb.metrics(spark, sf), "value", by=("tag",))


# --------------------------------------------------------------------------
# decoding and inspection
# --------------------------------------------------------------------------

_DECODED = (f"with v as ({_VOCAB_SQL}), p as (select doc_id, unnest({S.pieces('text')}) as piece, "
            f"generate_subscripts({S.pieces('text')}, 1) as pos from documents), "
            "d as (select doc_id, string_agg(case when v.id is null or v.id < 4 then '' else v.piece end, '' order by pos) as s "
            "from p left join v using (piece) group by doc_id), "
            "dec as (select doc_id, case when starts_with(replace(s, '▁', ' '), ' ') then substr(replace(s, '▁', ' '), 2) "
            "else replace(s, '▁', ' ') end as decoded from d)")


def decoded_docs(spark, sf):
    t = tb.text_table(spark, sf)
    v = word_vocab(spark, sf)
    tok = tokenise.tokenize_pretrain(t.select("doc_id", "text"), v)
    return tokenise.decode(tok, v, key="doc_id")


@register("t6_decode", _DECODED + " select doc_id, decoded from dec")
def t6_decode(spark, sf):
    return decoded_docs(spark, sf)


@register("t7_roundtrip_report",
          _DECODED + f", u as (select doc_id, count(*) filter (where v.id is null) as unk, count(*) as n from p left join v using (piece) "
          "group by doc_id) select lang as dataset, count(*) as docs, count(*) filter (where decoded = text) as equal_docs, "
          "cast(sum(unk) as bigint) as unknown_tokens, cast(sum(n) as bigint) as tokens from documents join dec using (doc_id) "
          "join u using (doc_id) group by lang")
def t7_roundtrip_report(spark, sf):
    v = word_vocab(spark, sf)
    lk = tokenise.make_lookup(v)
    enc = tokenise.encode(tb.text_table(spark, sf).select("dataset", "doc_id", "text"), lk, "text", "ids")
    enc = enc.withColumn("unk", F.size(F.filter("ids", lambda x: x == lk.unk_id))).withColumn("n", F.size("ids"))
    j = tokenise.decode(enc, v, "ids", key="doc_id", keep=["dataset", "text", "unk", "n"])
    return j.groupBy("dataset").agg(F.count(F.lit(1)).alias("docs"),
                                    F.count(F.when(F.col("decoded") == F.col("text"), 1)).alias("equal_docs"),
                                    F.sum("unk").cast("long").alias("unknown_tokens"),
                                    F.sum("n").cast("long").alias("tokens"))


@register("j6_inspect",
          _DECODED + " select doc_id, lang as dataset, cast(len(" + S.pieces("text") + ") + 2 as bigint) as n_tokens, "
          "decoded = text as roundtrip_equal from documents join dec using (doc_id)")
def j6_inspect(spark, sf):
    v = word_vocab(spark, sf)
    lk = tokenise.make_lookup(v)
    enc = tokenise.encode(tb.text_table(spark, sf).select("dataset", "doc_id", "text"), lk, "text", "ids")
    wrapped = enc.withColumn("ids", tokenise.wrap_sos_eos(F.col("ids"), tokenise.ids_of(lk, "[SOS]"),
                                                          tokenise.ids_of(lk, "[EOS]")))
    dec = tokenise.decode(wrapped, v, "ids", key="doc_id", keep=["dataset", "text"], pieces="pieces")
    return dec.select("doc_id", "dataset", F.size("pieces").cast("long").alias("n_tokens"),
                      (F.col("decoded") == F.col("text")).alias("roundtrip_equal"))


SMALL_VOCAB = 8000


@register("v7_compare_encodings",
          f"with a as ({S.word_vocab(VOCAB_SIZE)}), b as ({S.word_vocab(SMALL_VOCAB)}), "
          f"p as (select doc_id, unnest({S.pieces('text')}) as piece from documents), "
          "c as (select doc_id, count(*) filter (where coalesce(a.id, 0) <> coalesce(b.id, 0)) as diff, count(*) as n "
          "from p left join a using (piece) left join b using (piece) group by doc_id) "
          "select lang as dataset, count(*) as docs, count(*) filter (where diff = 0) as equal_docs, "
          "round(sum(diff) / sum(n), 6) as mismatch_rate from documents join c using (doc_id) group by lang")
def v7_compare_encodings(spark, sf):
    t = tb.text_table(spark, sf)
    small = vocab.train_word_vocab(t, SMALL_VOCAB, BASE_SPECIALS)
    return vocab.compare_encodings(t, word_vocab(spark, sf), small)


# --------------------------------------------------------------------------
# corpus preparation: sequential split, sampling, caps, interleave, union
# --------------------------------------------------------------------------

SEQ_SIZES = [("train", 700), ("validation", 100), ("test", 100)]
MAX_SAMPLES, MAX_LINES, CORPUS_CHUNK = 3000, 2500, 200
FRACTIONS = {"en": 0.5, "fr": 1.0, "de": 0.25, "es": 0.0}
LANG_ORDER = ["en", "fr", "de", "es"]
MAX_BYTES = 16384


def _seq_sql():
    cases, lo = [], 0
    for name, n in SEQ_SIZES:
        cases.append(f"when rn > {lo} and rn <= {lo + n} then '{name}'")
        lo += n
    return (f"select book_id, case {' '.join(cases)} end as split from (select book_id, row_number() over "
            f"(order by {S.h_seed('book_id')}, book_id) as rn from ({S.books()})) where rn <= {lo}")


@register("r3_split_sequential", _seq_sql())
def r3_split_sequential(spark, sf):
    return split.split_sequential(tb.books(spark, sf), "book_id", SEQ_SIZES, SEED).select("book_id", "split")


_CHUNKS = (f"select doc_id, cast(i // {CORPUS_CHUNK} as bigint) as chunk, array_to_string(w[i + 1 : i + {CORPUS_CHUNK}], ' ') as text "
           f"from (select doc_id, w, unnest(generate_series(0, len(w) - 1, {CORPUS_CHUNK})) as i "
           f"from (select doc_id, {S.words('text')} as w from documents) where len(w) > 0)")


@register("r4_prepare_corpus",
          f"select doc_id, chunk, line from (select doc_id, chunk, line, row_number() over (order by h, doc_id, chunk) as ln "
          r"from (select doc_id, chunk, h, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') as line from "
          f"(select *, {S.h_seed(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + '-' + chr(39) + ' || chunk')} as h from ({_CHUNKS}) "
          f"order by h, doc_id, chunk limit {MAX_SAMPLES})) where line <> '') where ln <= {MAX_LINES}")
def r4_prepare_corpus(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return split.prepare_corpus(d, CORPUS_CHUNK, MAX_SAMPLES, MAX_LINES, SEED)


@register("r5_sample_by_fraction",
          "select dataset, doc_id from (select *, row_number() over (partition by dataset order by "
          f"{S.h_seed('doc_id')}, doc_id) as rn, count(*) over (partition by dataset) as cnt from ({S.text_table()})) "
          "where rn <= floor(cnt * case dataset " + " ".join(f"when '{k}' then {v}" for k, v in FRACTIONS.items())
          + " else 0 end)")
def r5_sample_by_fraction(spark, sf):
    return split.sample_by_fraction(tb.text_table(spark, sf), FRACTIONS, "doc_id", "dataset", SEED).select(
        "dataset", "doc_id")


# requested shards of each dataset; a source is a shard
SHARDS = {"en": 5, "fr": 300, "de": 1, "es": 0}


@register("r5_sample_by_shards",
          "select dataset, doc_id, octet_length(encode(text)) as bytes from (select *, row_number() over (partition by dataset order by "
          f"{S.h_seed('doc_id')}, doc_id) as rn, count(*) over (partition by dataset) as cnt from ({S.text_table()})) join "
          "(select lang as dataset, count(distinct source) as a from documents group by lang) using (dataset) "
          "where rn <= cnt * least(a, case dataset " + " ".join(f"when '{k}' then {v}" for k, v in SHARDS.items())
          + " else 0 end) // a")
def r5_sample_by_shards(spark, sf):
    some = split.sample_by_shards(tb.text_table(spark, sf), SHARDS, "doc_id", "source", "dataset", SEED)
    return some.select("dataset", "doc_id", F.octet_length("text").alias("bytes"))


@register("r7_max_bytes", f"select doc_id, octet_length(encode(text)) as bytes from documents where octet_length(encode(text)) <= {MAX_BYTES}")
def r7_max_bytes(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return split.max_bytes(d, MAX_BYTES).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@register("w9_interleave",
          "with r as (select dataset, doc_id, row_number() over (partition by dataset order by doc_id) as rn, "
          + "case dataset " + " ".join(f"when '{g}' then {i}" for i, g in enumerate(LANG_ORDER)) + " end as gi "
          f"from ({S.text_table()})), m as (select min(c) as m from (select dataset, count(*) as c from r group by dataset)) "
          f"select dataset, doc_id, cast((rn - 1) * {len(LANG_ORDER)} + gi as bigint) as position from r where rn <= (select m from m)")
def w9_interleave(spark, sf):
    out = split.interleave(tb.text_table(spark, sf), "dataset", ["doc_id"], LANG_ORDER)
    return out.select("dataset", "doc_id", F.col("position").cast("long"))


@register("u1_union_all",
          "select 'documents' as dataset, cast(doc_id as varchar) as row_key, length(text) as n_chars from documents "
          "union all select 'conversations', cast(conv_id as varchar) || '-' || cast(turn as varchar), length(text) from conversations")
def u1_union_all(spark, sf):
    a = tb.read_table(spark, sf, "documents").select(F.lit("documents").alias("dataset"),
                                                     F.col("doc_id").cast("string").alias("row_key"), "text")
    b = tb.read_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("dataset"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_key"), "text")
    return split.union_all([a, b]).select("dataset", "row_key", F.length("text").cast("long").alias("n_chars"))


# --------------------------------------------------------------------------
# character model
# --------------------------------------------------------------------------

COVERAGE = 0.9995
_CHARS = f"(select unnest(string_split({S.metaspace('text')}, '')) as piece from documents)"
_CC = f"select piece, count(*) as freq from {_CHARS} group by piece"


@register("a7_char_coverage",
          f"select piece, freq from (select piece, freq, sum(freq) over (order by freq desc, piece rows between unbounded "
          f"preceding and current row) - freq as before, sum(freq) over () as total from ({_CC})) where before / total < {COVERAGE}")
def a7_char_coverage(spark, sf):
    return vocab.char_coverage(vocab.char_counts(tb.text_table(spark, sf)), COVERAGE)


@register("v3_char_vocab",
          f"select cast(3 + row_number() over (order by freq desc, piece) as integer) as id, piece from ({_CC}) "
          "union all " + " union all ".join(f"select {i}, {S.q(s)}" for i, s in enumerate(BASE_SPECIALS)))
def v3_char_vocab(spark, sf):
    return vocab.train_char_vocab(tb.text_table(spark, sf), BASE_SPECIALS).select("id", "piece")


@register("v6_score_table",
          f"with c as materialized (select piece, count(*) as freq from (select unnest({S.pieces('text')}) as piece from documents) group by piece), "
          f"k as materialized (select piece, freq, row_number() over (order by freq desc, piece) as rn from c "
          f"where piece not in ({', '.join(S.q(s) for s in BASE_SPECIALS)}) qualify rn <= {VOCAB_SIZE - len(BASE_SPECIALS)}), "
          "t as materialized (select cast(sum(freq) as double) as total from k) "
          f"select cast(rn + {len(BASE_SPECIALS) - 1} as integer) as id, piece, round(ln(freq / total), 6) as score from k, t union all "
          + " union all ".join(f"select {i}, {S.q(s)}, 0.0" for i, s in enumerate(BASE_SPECIALS)))
def v6_score_table(spark, sf):
    st = vocab.score_table(word_vocab(spark, sf))
    return st.select("id", "piece", F.round("score", 6).alias("score"))
