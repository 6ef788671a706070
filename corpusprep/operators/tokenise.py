"""Text -> id sequences and back.

Pre-tokenisation (metaspace split, special tokens cut out first) is a JVM
expression. The piece -> id lookup has two plans:

* ``encode``: Arrow pass over each partition. The vocabulary (bounded by
  vocab_size, size-checked) travels with the task and ``pyarrow.compute.index_in``
  maps whole batches of pieces in C++ - no shuffle, no per-token Python.
* ``encode_long``: pure DataFrame plan - ``posexplode`` + broadcast hash join,
  one row per token (the long form the oracle compares against).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import text as tx
from corpusprep.operators.vocab import bounded_broadcast, collect_vocab
from corpusprep.profiles import IGNORE_INDEX
from corpusprep.session import BROADCAST_ROW_LIMIT


# List entries that an Arrow pass works on at once.
LIST_VALUES = 1 << 18


def small_batches(batches, cols: Sequence[int], limit: int | None = None):
    """The batches again, cut where their lists (columns ``cols``) would hold
    over ``limit`` entries together; a longer row stands alone. A batch has so
    many rows, whatever their length, so what a pass makes of one would grow with
    the texts."""
    limit = limit or LIST_VALUES
    for b in batches:
        size = sum(pc.fill_null(pc.list_value_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                   for i in cols)
        ends, at = np.cumsum(size), 0
        if not len(ends) or ends[-1] <= limit:
            yield b
            continue
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
            yield b.slice(at, to - at)
            at = to


def pre_tokenise(text, model: str = "word", specials: Sequence[str] = ()) -> Column:
    if model == "word":
        return tx.pieces_with_specials(text, specials)
    if model == "char":
        return tx.chars(tx.metaspace(text))
    raise ValueError(f"unknown model: {model}")


class Lookup:
    """Picklable piece -> id table for tasks."""

    def __init__(self, pieces: list[str], ids: list[int], unk_id: int):
        self.pieces, self.ids, self.unk_id = pieces, ids, unk_id
        self._set = None

    def __getstate__(self):
        return {"pieces": self.pieces, "ids": self.ids, "unk_id": self.unk_id}

    def __setstate__(self, st):
        self.__init__(st["pieces"], st["ids"], st["unk_id"])

    def map_list_array(self, arr: pa.ListArray) -> pa.ListArray:
        if self._set is None:
            self._set = pa.array(self.pieces, pa.string())
            self._ids = np.asarray(self.ids, dtype=np.int32)
        flat = arr.flatten()
        idx = pc.index_in(flat, value_set=self._set)
        pos = idx.fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.where(pos >= 0, self._ids[np.maximum(pos, 0)], self.unk_id).astype(np.int32)
        offsets = arr.offsets
        if arr.offset != 0 or offsets[0].as_py() != 0:
            offsets = pc.subtract(offsets, offsets[0])
        return pa.ListArray.from_arrays(offsets, pa.array(out, pa.int32()), mask=arr.is_null())


def map_pieces_by_unique(arr: pa.ListArray, encode_pieces) -> pa.ListArray:
    """array<string> pieces -> array<int> ids where one piece may give several
    ids (subword models). The distinct pieces of the batch are encoded once and
    together (``encode_pieces`` has its own per-task cache); the output is
    gathered with numpy, so there is no per-token Python."""
    flat = arr.flatten()
    offsets = np.asarray(arr.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    if len(flat) == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(offsets), np.int32)),
                                        pa.array([], pa.int32()), mask=arr.is_null())
    d = pc.dictionary_encode(flat)
    enc = [np.asarray(u, dtype=np.int32) for u in encode_pieces(d.dictionary.to_pylist())]
    lens = np.array([e.size for e in enc], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    table = np.concatenate(enc) if enc else np.zeros(0, np.int32)
    idx = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    plens = lens[idx]
    total = int(plens.sum())
    piece_out_start = np.concatenate([[0], np.cumsum(plens)[:-1]])
    gather = np.repeat(starts[idx] - piece_out_start, plens) + np.arange(total)
    values = table[gather]
    tok_cum = np.concatenate([[0], np.cumsum(plens)])
    new_offsets = tok_cum[offsets].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(new_offsets), pa.array(values, pa.int32()), mask=arr.is_null())


def make_lookup(vocab: DataFrame, unk: str = "[UNK]") -> Lookup:
    pieces, ids = collect_vocab(vocab)
    d = dict(zip(pieces, ids))
    return Lookup(pieces, ids, d.get(unk, 0))


def _map_pieces(df: DataFrame, lookup: Lookup, cols: dict[str, str]) -> DataFrame:
    """Replace array<string> columns by array<int> ids, batch by batch."""
    fields = [T.StructField(f.name, T.ArrayType(T.IntegerType()), True) if f.name in cols
              else f for f in df.schema.fields]
    schema = T.StructType(fields)
    names = df.columns

    at = [i for i, n in enumerate(names) if n in cols]

    def run(batches):
        for b in small_batches(batches, at):
            arrays = [lookup.map_list_array(b.column(i)) if n in cols else b.column(i)
                      for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = df.mapInArrow(run, schema)
    for src, dst in cols.items():
        out = out.withColumnRenamed(src, dst)
    return out


def encode(df: DataFrame, vocab: DataFrame | Lookup, text: str | dict[str, str] = "text",
           out: str = "ids", model: str = "word", specials: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = ids of ``text``; several columns at once with a
    {text_col: out_col} mapping (one pass)."""
    lookup = vocab if isinstance(vocab, Lookup) else make_lookup(vocab)
    mapping = text if isinstance(text, dict) else {text: out}
    tmp = {}
    for i, (src, dst) in enumerate(mapping.items()):
        df = df.withColumn(f"_p{i}", pre_tokenise(F.col(src), model, specials))
        tmp[f"_p{i}"] = dst
    return _map_pieces(df, lookup, tmp)


def encode_long(df: DataFrame, vocab: DataFrame, key: str | Sequence[str], text: str = "text",
                model: str = "word", specials: Sequence[str] = (),
                unk_id: int = 0) -> DataFrame:
    """T1 as a join: one row (key.., pos, id) per token; unknown -> unk_id."""
    keys = [key] if isinstance(key, str) else list(key)
    exploded = df.select(*keys, F.posexplode(pre_tokenise(F.col(text), model, specials))
                         .alias("pos", "piece"))
    v = bounded_broadcast(vocab.select("piece", "id"))  # bounded by vocab_size, checked
    return (exploded.join(v, "piece", "left")
            .select(*keys, F.col("pos").cast("long"),
                    F.coalesce("id", F.lit(unk_id)).cast("long").alias("id")))


def wrap_sos_eos(ids, sos_id: int, eos_id: int) -> Column:
    """[SOS] + ids + [EOS]."""
    return F.concat(F.array(F.lit(sos_id)), ids, F.array(F.lit(eos_id)))


def mask_prompt(prompt_ids, completion_ids) -> Column:
    """labels = [-100]*len(prompt) + completion."""
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(prompt_ids)), completion_ids)


def drop_last(a) -> Column:
    """X2 ``a[:-1]``."""
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def drop_first(a) -> Column:
    """X2 ``a[1:]``."""
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def ids_of(vocab_lookup: Lookup, piece: str) -> int:
    return dict(zip(vocab_lookup.pieces, vocab_lookup.ids))[piece]


def tokenize_pretrain(df: DataFrame, vocab, model: str = "word",
                      specials: Sequence[str] = ()) -> DataFrame:
    """input_ids = [SOS] + ids(text) + [EOS]; text column dropped."""
    lk = vocab if isinstance(vocab, Lookup) else make_lookup(vocab)
    enc = encode(df, lk, "text", "_ids", model, specials)
    return (enc.withColumn("input_ids", wrap_sos_eos(F.col("_ids"), ids_of(lk, "[SOS]"),
                                                     ids_of(lk, "[EOS]")))
            .drop("_ids", "text"))


def tokenize_sft(df: DataFrame, vocab, specials: Sequence[str], model: str = "word") -> DataFrame:
    """Prompt and completion encoded separately, joined, prompt masked, shifted."""
    lk = vocab if isinstance(vocab, Lookup) else make_lookup(vocab)
    enc = encode(df, lk, {"prompt": "_p", "completion": "_c"}, model=model, specials=specials)
    full = F.concat("_p", "_c")
    labels = mask_prompt(F.col("_p"), F.col("_c"))
    return (enc.withColumn("input_ids", drop_last(full))
            .withColumn("labels", drop_first(labels))
            .drop("_p", "_c", "prompt", "completion"))


def tokenize_preference(df: DataFrame, vocab, specials: Sequence[str],
                        model: str = "word") -> DataFrame:
    """T4: prompt encoded once; [accepted, rejected] nested ids/labels;
    rewards [1.0, -1.0]."""
    lk = vocab if isinstance(vocab, Lookup) else make_lookup(vocab)
    enc = encode(df, lk, {"prompts": "_p", "accepted": "_a", "rejected": "_r"},
                 model=model, specials=specials)
    ids = F.array(drop_last(F.concat("_p", "_a")), drop_last(F.concat("_p", "_r")))
    labels = F.array(drop_first(mask_prompt(F.col("_p"), F.col("_a"))),
                     drop_first(mask_prompt(F.col("_p"), F.col("_r"))))
    return (enc.withColumn("input_ids", ids).withColumn("labels", labels)
            .withColumn("rewards", F.array(F.lit(1.0), F.lit(-1.0)))
            .drop("_p", "_a", "_r", "prompts", "accepted", "rejected"))


def decode(df: DataFrame, vocab: DataFrame, ids: str = "input_ids", out: str = "decoded",
           skip_special: bool = True, key: str | Sequence[str] = "row_id", keep: Sequence[str] = (),
           pieces: str | None = None) -> DataFrame:
    """Ids -> pieces -> text (metaspace decoder: '▁' -> ' ', first space
    dropped); unknown ids give nothing, a null list gives an empty text. The key
    and ``keep`` columns stay beside it; ``pieces`` names a column for the piece
    list (specials included).

    Plan: the vocabulary travels with the task and whole batches are gathered
    in Arrow - no row per token, no shuffle. Beyond the size that may travel the
    plan is ``decode_joined``."""
    keys = list(dict.fromkeys([*([key] if isinstance(key, str) else key), *keep]))
    if vocab.count() > BROADCAST_ROW_LIMIT:
        if pieces:
            raise ValueError("the piece list needs a vocabulary that fits a task")
        return decode_joined(df, vocab, ids, out, skip_special, keys)
    rows = vocab.select("id", "piece", F.coalesce("is_special", F.lit(False)).alias("sp")).collect()
    size = max((r["id"] for r in rows), default=-1) + 2
    byte_of = np.full(size, -1)
    for r in rows:
        if r["piece"] in _BYTE_OF:
            byte_of[r["id"]] = _BYTE_OF[r["piece"]]
    in_bytes = (byte_of >= 0).sum() == len(_BYTE_OF)
    plain = [""] * size                 # the last entry stands for every unknown id
    shown = [""] * size
    for r in rows:
        plain[r["id"]] = r["piece"]
        shown[r["id"]] = "" if skip_special and r["sp"] else r["piece"]
    fields = [df.schema[k] for k in keys] + [T.StructField(out, T.StringType())]
    if pieces:
        fields.append(T.StructField(pieces, T.ArrayType(T.StringType())))
    names = [f.name for f in fields]

    def run(batches):
        table, full = pa.array(shown, pa.string()), pa.array(plain, pa.string())
        for b in small_batches(batches, [len(keys)]):
            col = b.column(len(keys))
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            at = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pa.array(np.where((at < 0) | (at >= size - 1), size - 1, at))
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(at)), "")
            if in_bytes:
                text = _spell_bytes(text, at.to_numpy(), offsets.to_numpy(), byte_of, shown)
            text = pc.replace_substring(text, tx.METASPACE, " ")
            text = pc.replace_substring_regex(text, r"\A ", "")
            cols = [*b.columns[:len(keys)], text]
            if pieces:
                cols.append(pa.ListArray.from_arrays(offsets, full.take(at)))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*keys, ids).mapInArrow(run, T.StructType(fields))


_BYTE_OF = {p: b for b, p in enumerate(tx.BYTE_PIECES)}


def _spell_bytes(text: pa.Array, at: np.ndarray, offsets: np.ndarray, byte_of: np.ndarray, shown: list[str]) -> pa.Array:
    """The texts again, with runs of byte pieces as the characters they spell
    (only rows that hold byte pieces are touched)."""
    total = np.concatenate([[0], np.cumsum(byte_of[at] >= 0)])
    rows = np.flatnonzero(np.diff(total[offsets]))
    if not len(rows):
        return text
    out = text.to_pylist()
    for i in rows.tolist():
        parts = [bytes([byte_of[x]]) if byte_of[x] >= 0 else shown[x].encode() for x in at[offsets[i]:offsets[i + 1]].tolist()]
        out[i] = b"".join(parts).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def decode_joined(df: DataFrame, vocab: DataFrame, ids: str = "input_ids", out: str = "decoded",
                  skip_special: bool = True, key: str | Sequence[str] = "row_id") -> DataFrame:
    """T6 as a join, for a vocabulary that no task should hold: posexplode, join
    and ordered re-collect per row."""
    keys = [key] if isinstance(key, str) else list(key)
    v = bounded_broadcast(vocab.select("id", "piece", "is_special"))
    ex = df.select(*keys, F.posexplode_outer(ids).alias("pos", "id")).join(v, "id", "left")
    shown = F.coalesce(F.col("piece"), F.lit(""))
    if skip_special:
        shown = F.when(F.coalesce(F.col("is_special"), F.lit(False)), F.lit("")).otherwise(shown)
    ex = ex.withColumn("piece", shown)
    g = ex.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_s"))
    joined = F.array_join(F.transform("_s", lambda s: F.coalesce(s["piece"], F.lit(""))), "")
    txt = F.replace(joined, F.lit(tx.METASPACE), F.lit(" "))
    txt = F.when(txt.startswith(" "), F.substring(txt, 2, 1 << 30)).otherwise(txt)
    return g.select(*keys, txt.alias(out))
