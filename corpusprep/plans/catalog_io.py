"""Registered queries (continued): sources, sinks, streaming ingest and the
end-to-end tokenise job. Each query derives its input from the given tables,
writes it with the sink under a fresh folder of the session's shared
checkpoint folder and returns what the matching source reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators import order, pack, split, stats, tree, vocab
from corpusprep.plans import jobs
from corpusprep.plans import sqlparts as S
from corpusprep.plans.catalog import (_PAIR_ROWS, BATCH, CTX, CORPUS_CHUNK, MAX_LINES, MAX_SAMPLES, ORACLE, SEED, chat_vocab,
                                      pretrain_tokens, register, split_text, word_vocab)
from corpusprep.sources import io
from corpusprep.sources import tables as tb
from corpusprep.streaming import ingest

RECORDS_PER_FILE = 100
FILES_PER_TRIGGER = 2
_SPLIT = S.split_exact(20)


def _written_splits(spark, sf):
    root = io.scratch_path(spark, "splits")
    io.write_splits(split_text(spark, sf).select("dataset", "split", "doc_id", "text"), root)
    return root


@register("s1_read_splits",
          f"select dataset, split, doc_id from ({_SPLIT}) where dataset in ('en', 'fr') and split in ('validation', 'test')")
def s1_read_splits(spark, sf):
    root = _written_splits(spark, sf)
    # 'xx' is absent: warned about and skipped
    return io.read_splits(spark, root, ["en", "fr", "xx"], ["validation", "test"]).select("dataset", "split", "doc_id")


@register("k1_write_splits", f"select dataset, split, count(*) as rows from ({_SPLIT}) group by dataset, split")
def k1_write_splits(spark, sf):
    root = _written_splits(spark, sf)
    return io.read_splits(spark, root).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("rows"))


_V3 = ORACLE["v3_word_vocab"]


@register("k2_numbered_files",
          "select printf('books_%05d.jsonl', cast((rn - 1) // {n} as integer)) as file, cast(count(*) as bigint) as rows, "
          "cast(sum(length(text)) as bigint) as chars, "
          "md5(string_agg(md5(text), '' order by rn)) as content from (select text, row_number() over (order by doc_id) as rn from documents) "
          "group by file".format(n=RECORDS_PER_FILE))
def k2_numbered_files(spark, sf):
    root = io.scratch_path(spark, "numbered")
    io.write_numbered(tb.read_table(spark, sf, "documents").select("doc_id", "text"), root, ["doc_id"], RECORDS_PER_FILE)
    files = spark.read.text(f"{root}/*.jsonl", wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    texts = F.transform(F.filter(F.split("value", "\n"), lambda x: x != ""), lambda x: F.get_json_object(x, "$.text"))
    t = files.select("file", texts.alias("t"))      # a file holds RECORDS_PER_FILE texts at most
    return t.select("file", F.size("t").cast("long").alias("rows"),
                    F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
                    F.md5(F.array_join(F.transform("t", lambda x: F.md5(x)), "")).alias("content"))


def _saved_vocab(spark, sf):
    path = io.scratch_path(spark, "vocab")
    io.save_vocab(word_vocab(spark, sf), path)
    return path


@register("k4_save_vocab", _V3)
def k4_save_vocab(spark, sf):
    return io.load_vocab(spark, _saved_vocab(spark, sf)).select("id", "piece")


@register("s2_read_strict", f"select id, piece, id < 4 as is_special from ({_V3})")
def s2_read_strict(spark, sf):
    return io.read_strict(spark, _saved_vocab(spark, sf), io.VOCAB_FILE_SCHEMA).select("id", "piece", "is_special")


_P2 = ORACLE["p2_book_text"]


def _book_text(spark, sf):
    b = tb.books(spark, sf)
    return b.select("book_id", tx.book_text("title_src", "author_src", "date1_src", "text_by_page_src").alias("text"))


@register("s3_read_jsonl", f"select text from ({_P2})")
def s3_read_jsonl(spark, sf):
    root = io.write_jsonl(_book_text(spark, sf), io.scratch_path(spark, "jsonl"), RECORDS_PER_FILE)
    return io.read_jsonl(spark, root).select("text")


@register("k2_write_jsonl", f"select count(*) as rows, true as within_limit from ({_P2})")
def k2_write_jsonl(spark, sf):
    root = io.write_jsonl(_book_text(spark, sf), io.scratch_path(spark, "jsonl"), RECORDS_PER_FILE)
    per = io.read_jsonl(spark, root).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), (F.max("n") <= RECORDS_PER_FILE).alias("within_limit"))


_R4 = ORACLE["r4_prepare_corpus"]


def _written_corpus(spark, sf):
    d = tb.read_table(spark, sf, "documents")
    lines = split.prepare_corpus(d, CORPUS_CHUNK, MAX_SAMPLES, MAX_LINES, SEED)
    return io.write_corpus(lines, io.scratch_path(spark, "corpus"))


@register("k3_write_corpus", f"select count(*) as lines, cast(sum(octet_length(encode(line))) as bigint) as bytes from ({_R4})")
def k3_write_corpus(spark, sf):
    back = io.read_lines(spark, _written_corpus(spark, sf))
    return back.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@register("s4_read_lines", f"select line as text from ({_R4})")
def s4_read_lines(spark, sf):
    return io.read_lines(spark, _written_corpus(spark, sf))


_S5 = (f"select lang as dataset, text from documents "
       f"union all select 'wiki', text from ({ORACLE['a4_coalesce_articles']}) "
       f"union all select 'books', text from ({_P2}) "
       f"union all select 'instructions', prompt || completion from ({S.sft_rows()})")


@register("s5_read_public_table",
          f"select dataset, count(*) as rows, cast(sum(length(text)) as bigint) as chars from ({_S5}) group by dataset")
def s5_read_public_table(spark, sf):
    t = io.read_public_tables(spark, io.PUBLIC_TABLES, sf)
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).cast("long").alias("chars"))


def _book_shards(spark, sf):
    """Raw book rows as JSON-lines shards (the input folder of the stream)."""
    root = io.scratch_path(spark, "book-shards")
    tb.books(spark, sf).write.option("maxRecordsPerFile", RECORDS_PER_FILE).json(root)
    return root


@register("s6_stream_ingest", f"select book_id, text, token_count from ({_P2})")
def s6_stream_ingest(spark, sf):
    shards = _book_shards(spark, sf)
    out, ck = io.scratch_path(spark, "ingested"), io.scratch_path(spark, "ingest-ckpt")
    ingest.stream_ingest(spark, shards, out, ck, max_files_per_trigger=FILES_PER_TRIGGER)
    return spark.read.parquet(out).select("book_id", "text", "token_count")


@register("a9_running_totals",
          f"select count(*) as ok, cast(0 as bigint) as failed, cast(sum(token_count) as bigint) as tokens from ({S.books()})")
def a9_running_totals(spark, sf):
    shards = _book_shards(spark, sf)
    out, ck = io.scratch_path(spark, "totals"), io.scratch_path(spark, "totals-ckpt")
    ingest.running_totals(spark, shards, out, ck, max_files_per_trigger=FILES_PER_TRIGGER)
    return spark.read.parquet(out).select("ok", "failed", "tokens")


# The stream in seeded order, every thirteenth book with a page missing; splits
# take 70 %, 10 % and 5 % of the records, the rest is left in the stream.
BROKEN_MOD = 13
QUOTAS = {"train": (7, 10), "validation": (1, 10), "test": (1, 20)}
_BOOK_COLUMNS = ["book_id", "title_src", "author_src", "date1_src", "text_by_page_src", "token_count"]
_QUOTA_ROWS = ("select doc_id, rn, case " + " ".join(
    f"when rn <= {' + '.join(f'n * {a} // {b}' for a, b in list(QUOTAS.values())[:i + 1])} then '{s}'" for i, s in enumerate(QUOTAS))
    + " end as split from (select doc_id, row_number() over (order by "
    f"{S.h_seed("doc_id")}, doc_id) as rn, count(*) over () as n from documents)")


def _quota_run(spark, sf):
    b = tb.books(spark, sf)
    broken = F.concat("text_by_page_src", F.array(F.lit(None).cast("string")))
    b = b.withColumn("text_by_page_src", F.when(F.col("book_id") % BROKEN_MOD == 0, broken).otherwise(F.col("text_by_page_src")))
    n = b.count()
    shards, out, ck = (io.scratch_path(spark, x) for x in ("quota-shards", "quota", "quota-ckpt"))
    b = b.withColumn("position", order.hash_order(SEED, "book_id"))
    io.write_numbered(b, shards, ["position", "book_id"], RECORDS_PER_FILE, text=["position", *_BOOK_COLUMNS])
    io.stamp_in_name_order(spark, shards)
    ingest.stream_quota(spark, shards, out, ck, {s: n * a // b for s, (a, b) in QUOTAS.items()}, ["position", "book_id"],
                        "position long, " + ingest.BOOK_SCHEMA, max_files_per_trigger=10 * FILES_PER_TRIGGER)
    return out


@register("s6_stream_quota", f"select r.split, b.book_id, b.text, b.token_count from ({_QUOTA_ROWS}) r join "
          f"(select book_id, text, token_count from ({_P2})) b on b.book_id = r.doc_id "
          f"where r.split is not null and r.doc_id % {BROKEN_MOD} <> 0")
def s6_stream_quota(spark, sf):
    return ingest.quota_rows(spark, _quota_run(spark, sf)).select("split", "book_id", "text", "token_count")


@register("a9_quota_totals", f"select r.split, count(*) as records, count(*) filter (where r.doc_id % {BROKEN_MOD} <> 0) as ok, "
          f"count(*) filter (where r.doc_id % {BROKEN_MOD} = 0) as failed, "
          f"cast(coalesce(sum(b.token_count) filter (where r.doc_id % {BROKEN_MOD} <> 0), 0) as bigint) as tokens "
          f"from ({_QUOTA_ROWS}) r join ({S.books()}) b on b.book_id = r.doc_id where r.split is not null group by r.split")
def a9_quota_totals(spark, sf):
    return ingest.quota_totals(spark, _quota_run(spark, sf)).filter("records > 0").select("split", "records", "ok", "failed", "tokens")


@register("k5_write_token_blocks", ORACLE["l1_pack_blocks"])
def k5_write_token_blocks(spark, sf):
    v = word_vocab(spark, sf)
    blocks = pack.pack_blocks(pretrain_tokens(spark, sf), CTX, ["doc_id"])
    path, _ = io.write_token_blocks(blocks, io.scratch_path(spark, "blocks"), "documents", v)
    b = spark.read.parquet(path)
    return b.select("block_id", F.posexplode("tokens").alias("pos", "id")).select(
        "block_id", F.col("pos").cast("long"), F.col("id").cast("long"))


@register("k6_append_metrics", f"select run, tag, cast(step as bigint) as step, value from ({S.metrics()})")
def k6_append_metrics(spark, sf):
    m = tb.metrics(spark, sf).select("run", "tag", F.col("step").cast("long"), "value")
    path = io.scratch_path(spark, "metrics")
    first = m.filter(F.col("step") % 2 == 0)
    io.append_metrics(first, path)
    io.append_metrics(m.filter(F.col("step") % 2 == 1), path)  # a second append to the same runs
    return spark.read.schema(m.schema).parquet(path).select("run", "tag", "step", "value")


# a log holds numbers and texts; a second append replaces only the runs it has
@register("k6_metric_texts",
          "select run, tag, cast(step as bigint) as step, case when step % 2 = 1 then value end as value, "
          f"case when step % 2 = 0 then tag || ' at ' || step end as text from ({S.metrics()})")
def k6_metric_texts(spark, sf):
    m = tb.metrics(spark, sf).select("run", "tag", F.col("step").cast("long"), "value")
    even = F.col("step") % 2 == 0
    note = F.concat("tag", F.lit(" at "), F.col("step").cast("string"))
    rows = m.select("run", "tag", "step", F.when(~even, F.col("value")).alias("value"), F.when(even, note).alias("text"))
    path = io.scratch_path(spark, "metric-texts")
    io.append_metrics(rows.withColumn("text", F.lit("replaced")), path)
    io.append_metrics(rows, path, overwrite=True)
    return spark.read.schema(rows.schema).parquet(path).select("run", "tag", "step", "value", "text")


HPARAMS = {"batch": float(BATCH), "ctx": float(CTX)}


@register("x11_hparams",
          f"select run, 'metric/' || tag as key, round(arg_max(value, step), 6) as value from ({S.metrics()}) group by run, tag "
          + " ".join(f"union all select distinct run, 'hparam/{k}', {v} from ({S.metrics()})" for k, v in sorted(HPARAMS.items())))
def x11_hparams(spark, sf):
    h = io.hparams_table(tb.metrics(spark, sf), HPARAMS)
    m = h.select("run", F.explode("metrics").alias("k", "value")).select(
        "run", F.concat(F.lit("metric/"), "k").alias("key"), F.round("value", 6).alias("value"))
    p = h.select("run", F.explode("hparams").alias("k", "value")).select(
        "run", F.concat(F.lit("hparam/"), "k").alias("key"), "value")
    return m.unionByName(p)


@register("t5_tokenize_all", ORACLE["a2_token_stats_total"])
def t5_tokenize_all(spark, sf):
    src = _written_splits(spark, sf)
    v = vocab.train_word_vocab(io.read_splits(spark, src, "all", ["train"]), 32000, ["[UNK]", "[PAD]", "[SOS]", "[EOS]"])
    return jobs.tokenize_all(spark, src, io.scratch_path(spark, "tokenised"), v)


# T5 in the two post-training modes: conversations as instruction rows (every
# tenth in the test split) and as preference pairs.

_LEN = f"len({S.pieces_with_specials('p', S.ALL_SPECIALS)}) + len({S.pieces_with_specials('c', S.ALL_SPECIALS)}) - 1"
_SFT = (f"select 'alpaca' as dataset, case when id % 10 = 0 then 'test' else 'train' end as split, {_LEN} as n "
        f"from (select id, prompt as p, completion as c from ({S.sft_rows()}))")


def _stats_sql(rows: str) -> str:
    agg = "cast(sum(n) as bigint) as total_tokens, count(*) as examples, round(sum(n) / count(*), 6) as avg_tokens"
    return (f"with r as ({rows}) select dataset, split, {agg} from r group by dataset, split "
            f"union all select 'ALL', 'ALL', {agg} from r")


@register("t5_tokenize_all_sft", _stats_sql(_SFT))
def t5_tokenize_all_sft(spark, sf):
    p, c = tx.format_instruction("instruction", "input", "output")
    rows = tb.instructions(spark, sf).select(
        F.lit("alpaca").alias("dataset"), F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"),
        "id", p.alias("prompt"), c.alias("completion"))
    root = io.write_splits(rows, io.scratch_path(spark, "sft"))
    return jobs.tokenize_all(spark, root, io.scratch_path(spark, "sft-tokenised"), chat_vocab(spark, sf),
                             splits=("train", "test"), mode="post_training_sft")


@register("t5_tokenize_all_preference",
          _stats_sql(f"select 'openassistant' as dataset, 'train' as split, 2 as n from ({_PAIR_ROWS})"))
def t5_tokenize_all_preference(spark, sf):
    """A row's nested ids count as 2 (A1)."""
    pairs = tree.preference_pairs(tb.messages(spark, sf)).select(
        F.lit("openassistant").alias("dataset"), F.lit("train").alias("split"), "node_id", "accepted_id", "rejected_id",
        "prompts", "accepted", "rejected")
    root = io.write_splits(pairs, io.scratch_path(spark, "pairs"))
    return jobs.tokenize_all(spark, root, io.scratch_path(spark, "pairs-tokenised"), chat_vocab(spark, sf),
                             splits=("train",), mode="post_training_rl")


@register("a11_batches_per_epoch_rows",
          f"select split, count(*) as rows, count(*) // {BATCH} as batches from ({_SPLIT}) group by split")
def a11_batches_per_epoch_rows(spark, sf):
    return stats.batches_per_epoch_rows(split_text(spark, sf), BATCH)
