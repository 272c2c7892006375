"""Training-order materialisation of token ids.

Documents are range-partitioned by id and tokenised; every document becomes sequences of SEQUENCE tokens (the last one is
padded), numbered in the order of the documents. A keyed Feistel permutation with cycle walking sends each of the N
numbers to a global slot, so the training order is random, dense, invertible and needs no sort key to be stored. Slot s is
row s mod SHARD_ROWS of shard s div SHARD_ROWS. A shard is one file in slot order, written by one task; its rows have a
fixed stride (padded with 0; n_tokens tells the ids), so shard and row follow from the slot, and a reader resumes at any
slot. The query and the pipeline's last stage write the shards and return their rows read back, without the padding.

The tokenizer is a sentencepiece model (byte fallback, so nothing is unknown) whose path is a parameter; it is opened on
the executors. Ids are uint16, little-endian. The model's blank (U+2581) in a text is written as its three bytes. The
piece that stands for a leading blank is kept, so decoding gives the text back exactly.

Defined results: null and empty texts have one sequence without tokens; null ids come first; repeated rows are documents
of their own; an empty table has no slots; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StructType

from . import textops
from .common import cut, delete_at_end, documents, parts, shared_path, text_hash

SEQUENCE, SHARD_ROWS, ROUNDS, KEY = 1024, 4096, 6, 20240229
BLANK, FIRST_BYTE = "▁", 3
WORDS = re.compile(" +[^ ]*")
#: Characters of distinct words whose ids a task holds before it begins anew.
KNOWN_CHARS = 2 << 20
RUN_BYTES, LEARNED_WORDS = 6 << 20, 1 << 15
ROWS = "doc_id {}, text_hash long, range_id int, number long, seq_no int, n_tokens int, tokens binary"


def default_model() -> str:
    import public_tokenizers

    return os.path.join(os.path.dirname(public_tokenizers.__file__), "piece_bpe_32k.model")


class Tokenizer:
    """Encodes word by word, each distinct word once, where no piece of the model reaches over a blank into the next word:
    merges then never cross words, so the ids are those of the whole text (else it encodes whole texts)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = BLANK in pieces and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.alone = {"": np.asarray([self.model.piece_to_id(BLANK)], "<u2").tobytes()}
        self.known, self.held = dict(self.alone), 0

    def words(self, text: str) -> list[str]:
        """The words, each with the blanks before it but for one (which encoding adds)."""
        if text[:1] == " " or "  " in text:
            return [w[1:] for w in WORDS.findall(" " + text)]
        return text.split(" ")

    def learn(self, words: Iterable[str]) -> None:
        """Know the ids of words; of what was known before, all is given up once it is much."""
        if self.held > KNOWN_CHARS:
            self.known, self.held = dict(self.alone), 0
        every = [w for w in words if w not in self.known]
        for at in range(0, len(every), LEARNED_WORDS):  # lists of ids are large
            new = every[at : at + LEARNED_WORDS]
            ids = self.model.encode(new, num_threads=1)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            data = np.fromiter(chain.from_iterable(ids), "<u2", int(n.sum())).tobytes()
            ends = np.cumsum(2 * n).tolist()
            self.known.update(zip(new, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            self.held += sum(map(len, new))

    def raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, two bytes each."""
        if not self.by_word:
            return [np.asarray(x, "<u2").tobytes() for x in self.encode(texts)]
        mark = np.asarray([FIRST_BYTE + b for b in BLANK.encode()], "<u2").tobytes()
        split = [[self.words(part) if part else [] for part in (t.split(BLANK) if BLANK in t else [t])] for t in texts]
        self.learn({w for parts_ in split for x in parts_ for w in x})
        get = self.known.__getitem__
        return [mark.join([b"".join(map(get, x)) for x in parts_]) for parts_ in split]

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, bytes | pa.Buffer]:
        """The ids of all texts as one stream, and how many bytes of it each text has."""
        texts = textops.own(texts)
        empty = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True).to_numpy(zero_copy_only=False)
        if self.by_word:
            odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, BLANK))
            odd = pc.fill_null(odd, False).to_numpy(zero_copy_only=False)
        else:
            odd = ~empty
        words = pc.split_pattern(textops.own(texts, odd | empty), " ")
        d = words.flatten().dictionary_encode()
        vocabulary = d.dictionary.to_pylist()
        self.learn(vocabulary)
        ids = pa.array(list(map(self.known.__getitem__, vocabulary)), pa.binary()).take(d.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset) if len(ids) else np.zeros(1, np.int32)
        at = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())))].astype(np.int64)
        size, data = np.diff(at), ids.buffers()[2] if len(ids) else b""
        if odd.any():
            where = np.flatnonzero(odd)
            raw, view = self.raw(texts.take(pa.array(where)).to_pylist()), memoryview(data)
            size[where] = list(map(len, raw))
            cuts = at[where].tolist()
            data = b"".join(x for a, b, r in zip([int(at[0]), *cuts], [*cuts, int(at[-1])], [*raw, b""], strict=False) for x in (view[a:b], r))
            return size, data
        return size, data if not len(at) or not at[0] else data[int(at[0]) : int(at[-1])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, encoded whole."""
        out = self.model.encode([t if BLANK not in t else "" for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if BLANK in t:
                parts_, out[i] = t.split(BLANK), []
                for n, p in enumerate(parts_):
                    out[i] += ([FIRST_BYTE + b for b in BLANK.encode()] if n else []) + (self.model.encode(p) if p else [])
        return out

    def decode(self, ids: list[int]) -> str:
        mark = [FIRST_BYTE + b for b in BLANK.encode()]
        pieces, at = [], 0
        for i in range(len(ids) - 2):
            if ids[i : i + 3] == mark:
                pieces.append(self.model.decode(ids[at:i]))
                at = i + 3
        return BLANK.join([*pieces, self.model.decode(ids[at:])])


def tokeniser(path: str, sequence: int):
    stride = 2 * sequence

    def run(batches):
        from pyspark import TaskContext

        me, number, tok = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            tok = tok or Tokenizer(path)
            for a, z in textops.runs(batch["text"], RUN_BYTES):
                b = batch.slice(a, z - a)
                size, data = tok.stream(b["text"])
                many = np.maximum(1, -(-size // stride))
                at = np.repeat(np.arange(len(size)), many)
                seq = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                ends = np.cumsum(size)
                first = (ends - size)[at] + stride * seq
                offsets = np.append(first, ends[-1]).astype(np.int32)  # sequences follow one another without gaps
                tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                of = pa.array(at)
                yield pa.record_batch([b["doc_id"].take(of), b["text_hash"].take(of), pa.array(np.full(len(at), me, np.int32)), pa.array(np.arange(number, number + len(at))), pa.array(seq, pa.int32()), pa.array(np.diff(offsets) // 2, pa.int32()), tokens], ["doc_id", "text_hash", "range_id", "number", "seq_no", "n_tokens", "tokens"])
                number += len(at)
        pa.default_memory_pool().release_unused()  # workers live on

    return run


def feistel(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network over an even number of bits, walked until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(b"%d:%d" % (key, r))) for r in range(ROUNDS)]

    def f(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v + k) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (v ^ (v >> np.uint64(32))) & mask

    out = np.asarray(x, np.int64).astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ f(left, k), left
            else:
                left, right = right, left ^ f(right, k)
        out[todo] = (left << np.uint64(half)) | right
        todo &= out >= n
    return out.astype(np.int64)


def materialise(docs: DataFrame, model: str | None = None, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Rows in slot order within range partitions: slot, shard, shard_row, doc_id, seq_no, n_tokens, tokens (unpadded ids)."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", text_hash().alias("text_hash")).repartitionByRange(parts(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    t = cut(d.mapInArrow(tokeniser(model or default_model(), sequence), ROWS.format(docs.schema["doc_id"].dataType.simpleString())), "tokens")
    made = {r.range_id: r.n for r in t.groupBy("range_id").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    total, first, at = sum(made.values()), [], 0
    for k in sorted(made):
        first.append((k, at))
        at += made[k]

    @pandas_udf("long")
    def slot(x):
        import pandas as pd

        return pd.Series(feistel(x.to_numpy(), total, key))

    t = t.join(F.broadcast(spark.createDataFrame(first, "range_id int, before long")), "range_id")
    t = t.withColumn("slot", slot(F.col("before") + F.col("number"))).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    t = t.repartitionByRange(parts(spark), "shard").sortWithinPartitions("shard", "slot")  # a shard is never split
    return t.select("slot", "shard", (F.col("slot") % shard_rows).cast("int").alias("shard_row"), "doc_id", "text_hash", "seq_no", "n_tokens", "tokens")


def write_shards(rows: DataFrame, path: str, sequence: int = SEQUENCE) -> None:
    """Fixed-stride shards: one file a shard, rows in slot order, each with exactly 2 * sequence bytes (padded with 0).

    Rows are those of materialise(), whose partitions hold whole shards. A failed task leaves no partial shard behind
    (the committer moves whole files), so a job can be run again.
    """
    out = rows.withColumn("tokens", F.rpad("tokens", F.lit(2 * sequence), F.lit(b"\0"))).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, shard_rows: int = SHARD_ROWS, schema: StructType | None = None) -> DataFrame:
    """Rows from a slot on, padded; shards before it aren't opened. With a schema there may be no shards at all."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where((F.col("shard") >= from_slot // shard_rows) & (F.col("slot") >= from_slot))


def shards(docs: DataFrame, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards of docs to the shared folder; their rows as they were written, with the padding taken off."""
    rows = materialise(docs, sequence=sequence, shard_rows=shard_rows).drop("text_hash")
    path = shared_path(docs.sparkSession, "shards")
    write_shards(rows, path, sequence)
    delete_at_end(docs.sparkSession, path)
    back = read_shards(docs.sparkSession, path, shard_rows=shard_rows, schema=rows.schema)
    return back.withColumn("tokens", F.substring("tokens", F.lit(1), 2 * F.col("n_tokens"))).select(*rows.columns)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the shards of docs: at least one for each row of docs, null and empty texts and repeated rows too; none of
    an empty table. Columns of docs other than doc_id and text are ignored."""
    return shards(docs)
