"""Operator 4: token counts from flat, unindexed token files.

``write_token_files`` encodes every text with a public byte-pair vocabulary (its path is a
parameter) and appends the 16-bit ids, an end-of-document id behind each text, to one flat
file per task, without any index.  ``scan_separators`` cuts the files into blocks, finds
the end-of-document ids of a block with one vectorised comparison and emits, per block, the
separators it holds.  Documents that cross block borders are stitched by a prefix scan over
the blocks of a file: the number of separators before a block numbers its documents, and the
last separator before it tells where its first document began.

Scale.  Tokenising and scanning are narrow; only one row per block (first and last
separator, count) and one per document are shuffled.  A file holds at most what one input
split gives; blocks are of fixed size and are read by offset, so no task holds a file.

Defined cases: a null text has no tokens, like an empty one, and counts 0; repeated rows are
counted each; doc_id may be null.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import arrow_batches, shared_dir, written
from .textbytes import text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizer that the public byte-pair vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20
#: A longer text is encoded in pieces, cut before a space that follows a non-space, where no token crosses.
PIECE = 1 << 16

_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, one per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def checked(vocabulary: str, end: int) -> None:
    """The separator must not be a token of the vocabulary, and all ids must fit in 16 bits."""
    top = encoder(vocabulary).max_token_value
    if end in encoder(vocabulary)._mergeable_ranks.values() or max(top, end) > 0xFFFF:
        raise ValueError(f"separator {end} is a token, or ids up to {max(top, end)} do not fit in 16 bits: {vocabulary}")


def _pieces(text: str) -> Iterator[str]:
    lo = 0
    while len(text) - lo > PIECE:
        cut = lo + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    own = encoder(vocabulary)
    return [t for piece in _pieces(text) for t in own.encode_ordinary(piece)]


def _filesystem(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Write flat token files under ``path``; returns (file, ordinal, doc_id) of what was written, already stored.

    A retried task writes another file name, and only names that the stored rows mention count.
    """
    checked(vocabulary, end)
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fs, inner = _filesystem(path)
    fs.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _filesystem(path)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
        out, n = None, 0
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{inner}/{name}")
            for text in text_bytes(batch.column(1)):
                ids = np.array([*encode(text.decode(), vocabulary), end], "<u2")
                out.write(ids.tobytes())
            rows = batch.num_rows
            ordinals = pa.array(np.arange(n, n + rows))
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows), ordinals, batch.column(0)], names=["file", "ordinal", "doc_id"])
            n += rows
        if out is not None:
            out.close()

    written_rows = docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}")
    return written(written_rows, "token-manifest")


def blocks(spark: SparkSession, path: str, files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, start, n) for every block of the files, in tokens."""
    sizes = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 2).cast("long").alias("n_all"))
    sizes = sizes.join(files, "file", "left_semi")
    n_blocks = F.ceil(F.col("n_all") / block_tokens)
    rows = sizes.filter("n_all > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    start = F.col("block") * block_tokens
    return rows.select("file", "block", start.alias("start"), F.least(F.lit(block_tokens), F.col("n_all") - start).alias("n"))


def scan_separators(spark: SparkSession, path: str, files: DataFrame, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{inner}/{row['file']}") as f:
                    ids = np.frombuffer(f.read_at(2 * row["n"], 2 * row["start"]), "<u2")
                found = np.flatnonzero(ids == end) + row["start"]
                columns = [[row["file"]], [row["block"]], [found.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks(spark, path, files, block_tokens).repartition(parts, "file", "block")
    found = written(spread.mapInArrow(run, "file string, block long, ends array<long>"), "token-blocks")
    # Prefix scan over the blocks of a file.
    heads = found.select("file", "block", F.size("ends").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = heads.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_ordinal"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("previous_end"),
    )
    joined = found.join(scanned, ["file", "block"]).select("file", "first_ordinal", "previous_end", "ends", F.posexplode("ends").alias("k", "stop"))
    earlier = F.coalesce(F.get("ends", F.col("k") - 1), F.col("previous_end"))
    return joined.select(
        "file", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), (earlier + 1).alias("start"), (F.col("stop") - earlier - 1).alias("n_tokens")
    )


def count_tokens(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of every row, by writing flat token files and scanning them for separators."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    manifest = write_token_files(docs, path, vocabulary)
    counted = scan_separators(spark, path, manifest.select("file").distinct(), block_tokens=block_tokens)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
