"""Token counts: separator scan over flat token streams without an index.

A token stream is a run of 2- or 4-byte ids in which each document ends with
the end-of-document id, cut into blocks anywhere. Each block is searched for
separators on its own; a prefix scan over the blocks' summaries then stitches
documents that cross block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import column
from loomgraph.store import fresh_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pieces into which byte-level BPE cuts a text first.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50256
BLOCK_IDS = 1 << 18

_encoders: dict[int, object] = {}


def read_ranks(path: str = TOKENIZER) -> bytes:
    """The vocabulary file (under 1 MB), read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """An encoder for the vocabulary, one per process."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def write_token_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tokenizer: str = TOKENIZER, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise whole texts into flat streams below ``path`` (default: the shared folder).

    Rows with kind 0 are blocks of a stream (stream, block, ids: uint16),
    rows with kind 1 list the documents of a stream in order (first ordinal,
    doc ids). A task writes one stream; blocks end anywhere.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_ranks(tokenizer))
    path = path or fresh_path(spark, "tokens")
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    names = ["kind", "stream", "block", "ids", "doc_ids"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def rows(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stream = encoder(held.value), TaskContext.get().partitionId()
        rest, block, docs_so_far = np.zeros(0, np.uint16), 0, 0
        for batch in batches:
            yield rows(1, stream, docs_so_far, None, batch.column(0).to_pylist())
            docs_so_far += batch.num_rows
            pending, n = [rest], len(rest)
            for text in batch.column(1):
                ids = enc.encode_ordinary(text.as_py() or "")
                ids.append(END)
                pending.append(np.array(ids, np.uint16))
                n += len(ids)
                if n >= block_ids:
                    flat = np.concatenate(pending)
                    while len(flat) >= block_ids:
                        yield rows(0, stream, block, flat[:block_ids].tobytes(), None)
                        flat, block = flat[block_ids:], block + 1
                    pending, n = [flat], len(flat)
            rest = np.concatenate(pending)
        if len(rest):
            yield rows(0, stream, block, rest.tobytes(), None)

    out = docs.mapInArrow(encode, "kind int, stream int, block long, ids binary, doc_ids array<long>")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """Flat token files (below 2 GB each) as blocks: stream = the file's path, any Hadoop path."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                for k, at in enumerate(range(0, len(data), block_bytes // width * width)):
                    part = data[at : at + block_bytes // width * width].to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([part])], names=["stream", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(blocks, "stream string, block long, ids binary")


def separator_scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(stream, ordinal, n_tokens) for every document of the streams, separators not counted.

    ``blocks`` has stream, block, ids. Tokens after a stream's last separator
    are a document too (unterminated); an empty rest is none. Empty blocks
    and documents over many blocks are fine.
    """
    dtype = {2: np.uint16, 4: np.uint32}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, seps, inner = [], [], [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), dtype)
                at = np.flatnonzero(ids == end)
                seps.append(len(at))
                heads.append(int(at[0]) if len(at) else len(ids))
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append((np.diff(at) - 1).tolist())
            arrays = [batch.column(0), batch.column(1), pa.array(seps, pa.int64()), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["stream", "block", "seps", "head", "tail", "inner"])

    kind = blocks.schema["stream"].dataType.simpleString()
    found = blocks.select("stream", "block", "ids").mapInArrow(search, f"stream {kind}, block long, seps long, head long, tail long, inner array<long>")
    # the prefix scan over block summaries: separators before, and tokens since the last one
    before = "over (partition by stream order by block rows between unbounded preceding and 1 preceding)"
    run = found.withColumn("ordinal", F.expr(f"coalesce(sum(seps) {before}, 0)")).withColumn("part", F.expr(f"coalesce(sum(cast(seps > 0 as long)) {before}, 0)"))
    # part numbers the stretches that begin with a block's tail
    run = run.withColumn("first_of", F.expr("part + cast(seps > 0 as long)"))
    carry = run.select("stream", "block", "seps", "head", "inner", "ordinal", "tail", "part", "first_of")
    back = "over (partition by stream, part order by block rows between unbounded preceding and 1 preceding)"
    tail_of = run.where("seps > 0").select("stream", F.col("first_of").alias("part"), F.col("tail").alias("opened"))
    carry = carry.withColumn("passed", F.expr(f"coalesce(sum(case when seps = 0 then head else 0 end) {back}, 0)"))
    carry = carry.join(tail_of, ["stream", "part"], "left").withColumn("carry", F.col("passed") + F.coalesce("opened", F.lit(0)))
    ended = carry.where("seps > 0").select(
        "stream", F.col("ordinal"), F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens")
    ).select("stream", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")
    last = carry.groupBy("stream").agg(F.max_by(F.struct("seps", "tail", "carry", "head", "ordinal"), "block").alias("x"))
    rest = F.when(F.col("x.seps") > 0, F.col("x.tail")).otherwise(F.col("x.carry") + F.col("x.head"))
    open_end = last.select("stream", (F.col("x.ordinal") + F.col("x.seps")).alias("ordinal"), rest.alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(open_end)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every whole text, by way of flat streams and the separator scan.

    Null and empty texts have 0 tokens; the end mark is not counted; the
    mark's string in a text is ordinary text. Repeated rows are rows of their
    own, null ids stay null, an empty table gives none. Ids are whole numbers
    or texts of such; other columns are ignored. A very long text runs over
    many blocks.
    """
    stream = write_token_stream(docs, id_col, text_col, tokenizer=tokenizer)
    counts = separator_scan(stream.where("kind = 0").select("stream", "block", "ids"))
    ids = stream.where("kind = 1").select("stream", F.col("block").alias("from"), F.posexplode("doc_ids").alias("k", "doc_id"))
    ids = ids.select("stream", (F.col("from") + F.col("k")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["stream", "ordinal"], "left").select("doc_id", "n_tokens")
