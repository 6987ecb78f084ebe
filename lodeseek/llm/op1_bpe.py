"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash finds pre-tokens that are in the vocabulary as a whole; the
others are merged by a heap over linked bytes. Workers remember pieces between spaces in a
bounded memo; what it holds never changes a result.

Letters and numbers are those of Unicode 16, as in the tokenizer, whatever the regex module knows.

Edge cases: a null text is encoded like the empty one, to no ids; a null list of ids decodes
to no bytes; an id that is null, negative or outside the vocabulary is an error; texts of any
length are encoded whole; repeated rows each give a row; empty tables give empty results; all
other columns stay, one named like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import codec, decoder, int_lists, read_ranks, slices, text_batches


def _with(schema: T.StructType, *new: T.StructField) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([*(f for f in schema.fields if f.name not in names), *new])


def _coded(docs: DataFrame, vocabulary: str, pattern: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    raw = read_ranks(vocabulary)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    out = _with(docs.schema, *new)
    keep = [f.name for f in out.fields[: -len(new)]]

    def run(batches):
        enc, dec = codec(raw, pattern), decoder(raw) if decoded else None
        for batch in batches:
            for part, texts in slices(batch, text):
                blobs = [enc.encode(t) for t in texts]
                cols = [*(part.column(c) for c in keep), int_lists(blobs)]
                if dec:
                    cols.append(pa.array([dec(np.frombuffer(b, "<i4")) for b in blobs], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out.fields])

    return text_batches(docs).mapInArrow(run, out)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids: array<int>, of the whole text."""
    return _coded(docs, vocabulary, pattern, text, ids, None)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with ids and with decoded, the bytes of these ids: decode() of encode() in one pass over the texts."""
    return _coded(docs, vocabulary, pattern, text, ids, decoded)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with decoded: binary, the bytes of the ids."""
    raw = read_ranks(vocabulary)
    out = _with(rows.schema, T.StructField(decoded, T.BinaryType()))
    keep = [f.name for f in out.fields[:-1]]

    def run(batches):
        dec = decoder(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(ids).fill_null([])
                flat, ends = lists.values, lists.offsets.to_numpy()
                if flat.slice(ends[0], ends[-1] - ends[0]).null_count:
                    raise ValueError("an id is null")
                flat = flat.to_numpy(zero_copy_only=False)
                blobs = [dec(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(blobs, type=pa.binary())], names=[*keep, decoded])

    return text_batches(rows).mapInArrow(run, out)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    voc, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, voc, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
