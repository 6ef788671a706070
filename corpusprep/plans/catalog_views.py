"""Registered queries (continued): projections, orders, set operations, array
views, script split and byte fallback. Same conventions as ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators import formats, pack, split, tokenise, tree, vocab
from corpusprep.operators.order import global_rank, hash_order, order_by_file, skip, take_first
from corpusprep.plans import sqlparts as S
from corpusprep.plans.catalog import (_CHAT_VOCAB_SQL, _PAIR_ROWS, _VOCAB_SQL, BATCH, CHUNK_WORDS, MAX_BYTES,
                                      PAD_ID, SEED, SFT_CTX, _T3, long_pairs, pretrain_tokens, register,
                                      sft_tokens, word_vocab)
from corpusprep.profiles import BASE_SPECIALS, CHAT_SPECIALS, POST_TRAINING_V1
from corpusprep.sources import tables as tb

N_SENTENCES = 500
N_LIMIT = 100
N_SKIP = 100
TOP_N = 10
CHAT_VOCAB_SIZE = 2000
N_PREF_BATCHES = 2

_M = S.messages()
_EDGES = f"select parent_id, message_id from ({_M}) where parent_id is not null and parent_id <> ''"

# --------------------------------------------------------------------------
# projections and formats
# --------------------------------------------------------------------------


@register("p1_select_text", "select doc_id, text from documents")
def p1_select_text(spark, sf):
    return formats.select_text(tb.text_table(spark, sf), ["doc_id", "text"])


@register("p6_format_example",
          "select 'pre_training' as mode, cast(doc_id as varchar) as row_id, text as prompt, "
          "cast(null as varchar) as completion from documents "
          f"union all select 'post_training_sft', cast(id as varchar), prompt, completion from ({S.sft_rows()})")
def p6_format_example(spark, sf):
    pre = formats.format_example(tb.text_table(spark, sf).withColumn("row_id", F.col("doc_id").cast("string")),
                                 "pre_training", ["row_id"])
    pre = pre.select(F.lit("pre_training").alias("mode"), "row_id", F.col("text").alias("prompt"),
                     F.lit(None).cast("string").alias("completion"))
    ins = tb.instructions(spark, sf).withColumn("row_id", F.col("id").cast("string"))
    sft = formats.format_example(ins, "post_training_sft", ["row_id"])
    return pre.unionByName(sft.select(F.lit("post_training_sft").alias("mode"), "row_id", "prompt", "completion"))


# turns to render, and prompts that are rendered already
@register("p6_format_preference",
          "select 'openassistant' as mode, id, '<USER>' || instruction || '</USER>' || case when input is not null then "
          "'<MODEL>' || input || '</MODEL>' else '' end || '<MODEL>' as prompts, output || '</MODEL>' as accepted, "
          f"instruction || '</MODEL>' as rejected from ({S.instructions()}) "
          "union all select 'post_training_rl', id, instruction, output || '</MODEL>', instruction || '</MODEL>' "
          f"from ({S.instructions()})")
def p6_format_preference(spark, sf):
    i = tb.instructions(spark, sf)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("text"))
    context = F.filter(F.array(turn("prompter", "instruction"), turn("assistant", "input")), lambda t: t["text"].isNotNull())
    rows = i.select("id", context.alias("context"), F.col("instruction").alias("prompts"), F.col("output").alias("accepted"),
                    F.col("instruction").alias("rejected"))
    out = [formats.format_example(rows, mode, ["id"]).withColumn("mode", F.lit(mode)) for mode in ("openassistant", "post_training_rl")]
    return out[0].unionByName(out[1]).select("mode", "id", "prompts", "accepted", "rejected")


@register("c3_strip", rf"select pos, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from ({S.wiki_lines()})")
def c3_strip(spark, sf):
    return tb.wiki_lines(spark, sf).select("pos", tx.strip("text").alias("text"))


_SCRIPT_SQL = S.script_pattern()


@register("c6_split_by_script",
          f"select doc_id, cast(generate_subscripts(p, 1) - 1 as bigint) as pos, unnest(p) as piece from "
          f"(select doc_id, regexp_extract_all(text, '{_SCRIPT_SQL}') as p from documents)")
def c6_split_by_script(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    return (d.select("doc_id", F.posexplode(tx.split_by_script(F.col("text"))).alias("pos", "piece"))
            .select("doc_id", F.col("pos").cast("long"), "piece"))


COVERAGE = 0.9995
_CHARS = f"(select doc_id, unnest(string_split({S.metaspace('text')}, '')) as piece, " \
         f"generate_subscripts(string_split({S.metaspace('text')}, ''), 1) as i from documents)"
_COVERED = (f"select piece from (select piece, sum(freq) over (order by freq desc, piece rows between unbounded "
            f"preceding and current row) - freq as before, sum(freq) over () as total from "
            f"(select piece, count(*) as freq from {_CHARS} group by piece)) where before / total < {COVERAGE}")


@register("c7_byte_fallback",
          f"with c as ({_COVERED}), x as (select doc_id, i, case when piece in (select piece from c) then 1 "
          r"else octet_length(encode(piece)) end as n, case when piece in (select piece from c) then '' else "
          r"regexp_replace(hex(encode(piece)), '(..)', '<0x\1>', 'g') end as b from " + _CHARS + ") "
          "select doc_id, cast(sum(n) as bigint) as n_pieces, string_agg(b, '' order by i) as fallback from x group by doc_id")
def c7_byte_fallback(spark, sf):
    t = tb.text_table(spark, sf)
    covered = vocab.char_coverage(vocab.char_counts(t), COVERAGE)
    p = vocab.byte_fallback(t.select("doc_id", tx.chars(tx.metaspace(F.col("text"))).alias("p")), covered, "p")
    return p.select("doc_id", F.size("p").cast("long").alias("n_pieces"),
                    F.array_join(F.filter("p", lambda x: x.startswith("<0x")), "").alias("fallback"))


@register("x9_json_encode", "select doc_id, to_json(struct_pack(text := text)) as json from documents")
def x9_json_encode(spark, sf):
    return tb.read_table(spark, sf, "documents").select("doc_id", tx.to_json_text("text").alias("json"))


# --------------------------------------------------------------------------
# orders, limits, top-k
# --------------------------------------------------------------------------

_H = S.h_seed("doc_id")


@register("r1_shuffle",
          f"select doc_id, {_H} as shuffle_key, row_number() over (order by {_H}, doc_id) as position from documents")
def r1_shuffle(spark, sf):
    d = tb.read_table(spark, sf, "documents").select("doc_id", hash_order(SEED, "doc_id").alias("shuffle_key"))
    return global_rank(d, ["shuffle_key", "doc_id"], "position")


_SENT = (f"select doc_id, cast(i // {CHUNK_WORDS} as bigint) as chunk, array_to_string(w[i + 1 : i + {CHUNK_WORDS}], ' ') as text "
         f"from (select doc_id, w, unnest(generate_series(0, len(w) - 1, {CHUNK_WORDS})) as i "
         f"from (select doc_id, {S.words('text')} as w from documents) where len(w) > 0)")


@register("r8_input_sentence_sample",
          f"select doc_id, chunk, text from (select *, cast(doc_id as varchar) || '-' || cast(chunk as varchar) as k "
          f"from ({_SENT})) where octet_length(encode(text)) <= {MAX_BYTES} "
          f"order by {S.h_seed('k')}, k limit {N_SENTENCES}")
def r8_input_sentence_sample(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    s = (d.select("doc_id", F.posexplode(tx.chunk_words(F.col("text"), CHUNK_WORDS)).alias("chunk", "text"))
         .withColumn("chunk", F.col("chunk").cast("long"))
         .withColumn("k", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk").cast("string"))))
    return split.take(split.max_bytes(s, MAX_BYTES), N_SENTENCES, "k", SEED).select("doc_id", "chunk", "text")


@register("o1_order_by_rank",
          f"select message_id, row_number() over (order by coalesce(rank, 0), message_id) as position from ({_M}) "
          "where parent_id is not null and parent_id <> ''")
def o1_order_by_rank(spark, sf):
    m = tree.edges_with_rank(tb.messages(spark, sf))
    return global_rank(m, ["_r", "message_id"], "position").select("message_id", "position")


@register("o2_order_by_file", "select doc_id, row_number() over (order by doc_id) as position from documents")
def o2_order_by_file(spark, sf):
    return order_by_file(tb.read_table(spark, sf, "documents").select("doc_id"), ["doc_id"]).select(
        "doc_id", "position")


@register("o3_limit", f"select doc_id from documents order by {_H}, doc_id limit {N_LIMIT}")
def o3_limit(spark, sf):
    d = tb.read_table(spark, sf, "documents").select("doc_id")
    return take_first(d, N_LIMIT, [hash_order(SEED, "doc_id"), F.col("doc_id")])


@register("o4_skip", f"select doc_id from documents order by {_H}, doc_id offset {N_SKIP}")
def o4_skip(spark, sf):
    d = tb.read_table(spark, sf, "documents").select("doc_id", hash_order(SEED, "doc_id").alias("_h"))
    return skip(d, N_SKIP, ["_h", "doc_id"]).select("doc_id")


@register("o5_top_k",
          f"select group_id, item_id, round(score, 6) as score from ({S.candidates()}) "
          f"order by score desc, group_id, item_id limit {TOP_N}")
def o5_top_k(spark, sf):
    c = tb.candidates(spark, sf)
    top = take_first(c, TOP_N, [F.desc("score"), F.col("group_id"), F.col("item_id")])
    return top.select("group_id", "item_id", F.round("score", 6).alias("score"))


@register("w10_chunk_position",
          f"select doc_id, cast(i // {CHUNK_WORDS} as bigint) as chunk, cast(i as bigint) as first_word, "
          f"cast(least({CHUNK_WORDS}, len(w) - i) as bigint) as n_words from (select doc_id, w, "
          f"unnest(generate_series(0, len(w) - 1, {CHUNK_WORDS})) as i from (select doc_id, {S.words('text')} as w "
          "from documents) where len(w) > 0)")
def w10_chunk_position(spark, sf):
    d = tb.read_table(spark, sf, "documents").select("doc_id", tx.words("text").alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHUNK_WORDS)))
    e = d.select("doc_id", F.size("w").alias("nw"), F.posexplode(starts).alias("chunk", "i"))
    return e.select("doc_id", F.col("chunk").cast("long"), F.col("i").cast("long").alias("first_word"),
                    F.least(F.lit(CHUNK_WORDS), F.col("nw") - F.col("i")).cast("long").alias("n_words"))


# --------------------------------------------------------------------------
# joins and set operations over the message forest
# --------------------------------------------------------------------------


@register("j1_parent_child_join",
          f"with m as ({_M}) select c.message_id, c.parent_id, c.role, p.role as parent_role "
          "from m c join m p on c.parent_id = p.message_id")
def j1_parent_child_join(spark, sf):
    m = tb.messages(spark, sf)
    return tree.with_parent(m).select("message_id", "parent_id", "role", "parent_role")


@register("j2_semi_anti",
          f"with m as ({_M}), e as ({_EDGES}) select message_id, false as is_leaf from m where message_id in "
          "(select parent_id from e) union all select message_id, true from m where message_id not in "
          "(select parent_id from e)")
def j2_semi_anti(spark, sf):
    m = tb.messages(spark, sf).select("message_id", "parent_id")
    inner, leaves = tree.inner_and_leaves(m)
    return (inner.select("message_id", F.lit(False).alias("is_leaf"))
            .unionByName(leaves.select("message_id", F.lit(True).alias("is_leaf"))))


@register("j3_sibling_pair_counts",
          f"select parent_id, count(*) as n_children, count(*) * (count(*) - 1) // 2 as pairs from ({_EDGES}) "
          "group by parent_id")
def j3_sibling_pair_counts(spark, sf):
    return tree.sibling_pair_counts(tb.messages(spark, sf))


@register("g2_adjacency", _EDGES)
def g2_adjacency(spark, sf):
    return tree.edges(tb.messages(spark, sf))


@register("a12_distinct_parents", f"select distinct parent_id from ({_EDGES})")
def a12_distinct_parents(spark, sf):
    return tree.edges(tb.messages(spark, sf)).select("parent_id").distinct()


@register("u4_union_distinct",
          f"with m as ({_M}) select message_id as node_id from m where parent_id is null or parent_id = '' "
          f"union select parent_id from ({_EDGES})")
def u4_union_distinct(spark, sf):
    m = tb.messages(spark, sf)
    r = tree.roots(m).select(F.col("message_id").alias("node_id"))
    p = tree.edges(m).select(F.col("parent_id").alias("node_id"))
    return r.union(p).distinct()


_U2_KEYS = ("select 'documents' as dataset, doc_id as k from documents union all select 'conversations', "
            "conv_id * 1000 + turn from conversations")


@register("u2_interleave",
          f"with r as (select dataset, k, row_number() over (partition by dataset order by k) as rn, "
          f"case dataset when 'documents' then 0 else 1 end as gi from ({_U2_KEYS})), "
          "m as (select min(c) as m from (select dataset, count(*) as c from r group by dataset)) "
          "select dataset, k, cast((rn - 1) * 2 + gi as bigint) as position from r where rn <= (select m from m)")
def u2_interleave(spark, sf):
    a = tb.read_table(spark, sf, "documents").select(F.lit("documents").alias("dataset"),
                                                     F.col("doc_id").cast("long").alias("k"),
                                                     F.col("doc_id").alias("_id"), F.lit(0).alias("_turn"))
    b = tb.read_table(spark, sf, "conversations").select(
        F.lit("conversations").alias("dataset"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("k"),
        F.col("conv_id").alias("_id"), F.col("turn").alias("_turn"))
    out = split.interleave(split.union_all([a, b]), "dataset", ["_id", "_turn"], ["documents", "conversations"], unique=False)
    return out.select("dataset", "k", F.col("position").cast("long"))


# --------------------------------------------------------------------------
# array views of token sequences
# --------------------------------------------------------------------------

_T2 = (f"with v as ({_VOCAB_SQL}), p as (select doc_id, unnest({S.pieces('text')}) as piece, "
       f"generate_subscripts({S.pieces('text')}, 1) as pos from documents), "
       "t as (select doc_id, pos, coalesce(v.id, 0) as id from p left join v using (piece) "
       "union all select doc_id, 0, 2 from documents "
       f"union all select doc_id, len({S.pieces('text')}) + 1, 3 from documents)")


@register("t1_encode_word",
          f"with v as ({_VOCAB_SQL}), p as (select doc_id, unnest({S.pieces('text')}) as piece, "
          f"generate_subscripts({S.pieces('text')}, 1) - 1 as pos from documents) "
          "select doc_id, cast(pos as bigint) as pos, cast(coalesce(v.id, 0) as bigint) as id from p left join v using (piece)")
def t1_encode_word(spark, sf):
    t = tb.text_table(spark, sf).select("doc_id", "text")
    enc = tokenise.encode(t, word_vocab(spark, sf), "text", "ids")
    return enc.select("doc_id", F.posexplode("ids").alias("pos", "id")).select(
        "doc_id", F.col("pos").cast("long"), F.col("id").cast("long"))


@register("x2_shift_pair",
          _T2 + " select * from (select doc_id, cast(pos as bigint) as pos, cast(id as bigint) as x, "
          "cast(lead(id) over (partition by doc_id order by pos) as bigint) as y from t) where y is not null")
def x2_shift_pair(spark, sf):
    tok = pretrain_tokens(spark, sf)
    z = tok.select("doc_id", F.arrays_zip(tokenise.drop_last(F.col("input_ids")).alias("x"),
                                          tokenise.drop_first(F.col("input_ids")).alias("y")).alias("z"))
    e = z.select("doc_id", F.posexplode("z").alias("pos", "p"))
    return e.select("doc_id", F.col("pos").cast("long"), F.col("p.x").cast("long").alias("x"),
                    F.col("p.y").cast("long").alias("y"))


@register("x3_mask_prompt",
          f"select row_id, cast(0 as bigint) as pos, cast(-100 as bigint) as label from (select distinct row_id from {_T3}) "
          f"union all select row_id, pos + 1, id from {_T3} where which = 'labels'")
def x3_mask_prompt(spark, sf):
    i = tb.instructions(spark, sf)
    p, c = tx.format_instruction("instruction", "input", "output")
    rows = i.select("id", p.alias("prompt"), c.alias("completion"))
    enc = tokenise.encode(rows, vocab_chat(spark, sf), {"prompt": "_p", "completion": "_c"},
                          specials=POST_TRAINING_V1.specials)
    lab = enc.select(F.col("id").alias("row_id"), tokenise.mask_prompt(F.col("_p"), F.col("_c")).alias("l"))
    return lab.select("row_id", F.posexplode("l").alias("pos", "label")).select(
        "row_id", F.col("pos").cast("long"), F.col("label").cast("long"))


@register("x4_wrap_sos_eos",
          f"select doc_id, cast(len({S.pieces('text')}) + 2 as bigint) as n, cast(2 as bigint) as first_id, "
          "cast(3 as bigint) as last_id from documents")
def x4_wrap_sos_eos(spark, sf):
    tok = pretrain_tokens(spark, sf)
    return tok.select("doc_id", F.size("input_ids").cast("long").alias("n"),
                      F.element_at("input_ids", 1).cast("long").alias("first_id"),
                      F.element_at("input_ids", -1).cast("long").alias("last_id"))


@register("j5_zip_by_position",
          f"select row_id, pos, max(id) filter (where which = 'input_ids') as id, "
          f"max(id) filter (where which = 'labels') as label from {_T3} group by row_id, pos")
def j5_zip_by_position(spark, sf):
    tok = sft_tokens(spark, sf)
    z = tok.select(F.col("id").alias("row_id"), F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "z"))
    return z.select("row_id", F.col("pos").cast("long"), F.col("z.input_ids").cast("long").alias("id"),
                    F.col("z.labels").cast("long").alias("label"))


def vocab_chat(spark, sf):
    from corpusprep.plans.catalog import chat_vocab
    return chat_vocab(spark, sf)


_T4 = ("(select * from " + S.seq_long(f"select row_id, prompts as p, accepted as c from ({_PAIR_ROWS})",
                                      _CHAT_VOCAB_SQL, "cast(0 as bigint) as sub, ")
       + " union all select * from " + S.seq_long(f"select row_id, prompts as p, rejected as c from ({_PAIR_ROWS})",
                                                  _CHAT_VOCAB_SQL, "cast(1 as bigint) as sub, ") + ")")


def pref_tokens(spark, sf):
    pairs = tree.preference_pairs(tb.messages(spark, sf))
    rows = pairs.select(F.concat_ws("|", "node_id", "accepted_id", "rejected_id").alias("row_id"),
                        "prompts", "accepted", "rejected")
    return tokenise.tokenize_preference(rows, vocab_chat(spark, sf), POST_TRAINING_V1.specials)


@register("x6_explode_pairs",
          f"select row_id, sub, sub = 0 as accepted, count(*) filter (where which = 'input_ids') as n_ids, "
          f"count(*) filter (where which = 'labels' and id <> -100) as n_scored from {_T4} group by row_id, sub")
def x6_explode_pairs(spark, sf):
    e = pack.explode_pairs(pref_tokens(spark, sf), "row_id")
    return e.select("row_id", F.col("sub").cast("long"), "accepted",
                    F.size("input_ids").cast("long").alias("n_ids"),
                    F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_scored"))


@register("x8_prompt_and_completion",
          f"with t as (select * from {_T4} where sub = 0), k as (select row_id, min(pos) as k from t where which = 'labels' "
          "and id <> -100 group by row_id), n as (select row_id, count(*) as n from t where which = 'input_ids' group by row_id), "
          "c as (select row_id, coalesce(k, n) as cut from n left join k using (row_id)) "
          "select row_id, 'prompt' as which, pos, id from t join c using (row_id) where which = 'input_ids' and pos < cut "
          "union all select row_id, 'completion', row_number() over (partition by row_id order by pos) - 1, id from t "
          "where which = 'labels' and id <> -100")
def x8_prompt_and_completion(spark, sf):
    tok = pref_tokens(spark, sf)
    p, c = pack.prompt_and_completion()
    v = tok.select("row_id", p.alias("prompt"), c.alias("completion"))
    outs = [v.select("row_id", F.lit(w).alias("which"), F.posexplode(w).alias("pos", "id"))
            for w in ("prompt", "completion")]
    return outs[0].unionByName(outs[1]).select("row_id", "which", F.col("pos").cast("long"),
                                               F.col("id").cast("long"))


_PFIT = (f"with t as (select * from {_T4}), n as (select row_id, sub, which, count(*) as n from t group by row_id, sub, which), "
         f"f as (select row_id, sub, which, cast(pos - greatest(n - {SFT_CTX}, 0) as bigint) as pos, id from t "
         f"join n using (row_id, sub, which) where pos >= n - {SFT_CTX} "
         f"union all select row_id, sub, which, cast(p as bigint), cast(case when which = 'input_ids' then {PAD_ID} else -100 end as bigint) "
         f"from (select row_id, sub, which, unnest(generate_series(n, {SFT_CTX - 1})) as p from n where n < {SFT_CTX})), "
         f"r as (select row_id, row_number() over (order by row_id) as rank from (select distinct row_id from t)), "
         f"d as (select range as draw, {S.h_seed('range')} % (select count(*) from r) + 1 as rank from range({N_PREF_BATCHES * BATCH}))")


@register("l5_preference_batches",
          _PFIT + f" select cast(draw // {BATCH} as bigint) as batch_id, cast(draw % {BATCH} as bigint) as slot, "
          "sub = 0 as accepted, which, pos, f.id from d join r using (rank) join f on f.row_id = r.row_id")
def l5_preference_batches(spark, sf):
    ranked = global_rank(pref_tokens(spark, sf), ["row_id"], "rank")
    b = pack.preference_batches(ranked, N_PREF_BATCHES, BATCH, SFT_CTX, PAD_ID, SEED)
    outs = [b.select("batch_id", F.col("slot").cast("long"), "accepted", F.lit(w).alias("which"),
                     F.posexplode(w).alias("pos", "id")) for w in ("input_ids", "labels")]
    return outs[0].unionByName(outs[1]).select("batch_id", "slot", "accepted", "which", F.col("pos").cast("long"),
                                               F.col("id").cast("long"))


# --------------------------------------------------------------------------
# vocabulary ids for the chat profile
# --------------------------------------------------------------------------


@register("v4_assign_ids", S.word_vocab(CHAT_VOCAB_SIZE, specials=BASE_SPECIALS + CHAT_SPECIALS))
def v4_assign_ids(spark, sf):
    t = tb.text_table(spark, sf)
    return vocab.train_word_vocab(t, CHAT_VOCAB_SIZE, BASE_SPECIALS + CHAT_SPECIALS).select("id", "piece")
