"""Token-ID files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents as one array of 2- or 4-byte integers, then two
Elias-Fano sequences: the documents' start offsets and their keys. A sequence of n values up to
u takes about n * (2 + log2(u / n)) bits; every 256th one of its high bits has a 32-bit sample,
so that select finds a document's offset without a table of 64-bit offsets.

Documents are ranged by key (ties by a hash of the text, then by the row's place, so that one key's
rows can be split), each range is written by its own task into the shared folder under a temporary name and then
renamed, and the manifest (one row a file: name, counts) gives the files' bases. A task that
runs again writes the same bytes under the same name. Readers take the two sequences of a file, ask
select for offsets, and fetch the ids of some documents at a time.

Edge cases: a null text has only the end id; null keys come first and are kept; texts of any length
are encoded whole; repeated rows are written as often as they occur; other columns are left out,
whatever their names; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from .common import text_of
from .tokens import Memo, slices, text_batches

MAGIC = b"LDSK0001"
SAMPLE = 256
MEMO_ENTRIES = 500_000
END_ID = 2
#: Documents and ids that are read at once (or one document).
READ_DOCS, READ_IDS = 2000, 1 << 20


class EliasFano:
    """A sequence of n non-decreasing integers from 0 to u."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), dtype=np.uint8)
        for b in range(bits):
            low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, bits, pack(low.reshape(-1)), pack(high), places[::SAMPLE].astype("<u4"))

    def dump(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<QBQQ", blob)
        at = struct.calcsize("<QBQQ")
        samples = np.frombuffer(blob, "<u4", (n + SAMPLE - 1) // SAMPLE, at + a + b)
        return cls(n, bits, blob[at : at + a], blob[at + a : at + a + b], samples)

    def select(self, i: int) -> int:
        """The i-th value."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        word = self.high[byte] & (0xFF << (place & 7))  # the sample itself is the first bit that counts
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        start = i * self.low_bits
        stop = start + self.low_bits
        chunk = int.from_bytes(self.low[start >> 3 : (stop + 7) >> 3], "little") >> (start & 7)
        return (place - i) << self.low_bits | chunk & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values as int64."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        out = (np.flatnonzero(bits)[: self.n] - np.arange(self.n)) << self.low_bits
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            out |= low[:, b].astype(np.int64) << b
        return out


#: Letters that stay single under the tokenizer's normalisation and have a plain lower case; U+0130 has not.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: A whole piece between spaces that holds an apostrophe or a character beyond Latin and ASCII; else a run of letters, or of other characters but spaces.
_PARTS = re.compile(rf"[^ ]*['\u00aa\u00b5\u00ba\u0130\u0180-\U0010ffff][^ ]*|[{_LATIN}]+|[^ {_LATIN}]+")


#: The same where no such character is.
_ODD, _PLAIN_PARTS = re.compile("['\u00aa\u00b5\u00ba\u0130\u0180-\U0010ffff]"), re.compile(rf"[{_LATIN}]+|[^ {_LATIN}]+")
_LETTERS = re.compile(rf"[{_LATIN}]+")
#: Runs of letters that are encoded as one text.
ROW_WORDS = 64


class HuggingPieces:
    """Ids of texts by the tokenizers library, part by part.

    The tokenizer drops white space and no token, normalisation or merge reaches over a space.
    Within a piece between spaces, its pattern splits runs of letters from what is around them,
    but for contractions; so Latin pieces without an apostrophe are cut there too. Letters are
    looked up in lower case, as the tokenizer lowers them. Each new part is encoded once, in
    batches.
    """

    def __init__(self, spec: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.dtype = Tokenizer.from_str(spec), dtype
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        model = json.loads(spec)["model"]
        suffix = model.get("end_of_word_suffix")
        #: Whether a token ends a word, by id.
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True
        #: What all special tokens begin with, in lower case.
        self.mark = os.path.commonprefix([s.lower() for s in self.special])
        self.memo = Memo(lambda p: self.many([p])[0], MEMO_ENTRIES)

    def many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Runs of letters, each a word to the tokenizer, go in with others between spaces and are told apart by where words end."""
        out: list[bytes | None] = [None] * len(pieces)
        letters = [i for i, p in enumerate(pieces) if _LETTERS.fullmatch(p)] if self.ends.any() else []
        rows = [letters[at : at + ROW_WORDS] for at in range(0, len(letters), ROW_WORDS)]
        for row, x in zip(rows, self.tok.encode_batch_fast([" ".join([pieces[i] for i in row]) for row in rows], add_special_tokens=False)):
            ids = np.array(x.ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(row) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for i, stop in zip(row, (stops * ids.itemsize).tolist()):
                    out[i] = raw[at:stop]
                    at = stop
        rest = [i for i, v in enumerate(out) if v is None]
        for i, x in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(x.ids, dtype=self.dtype).tobytes()
        return out

    def parts(self, text: str) -> list[str]:
        low = text.lower()
        # lowering could also make a special token of what is none
        if self.mark in low and any(s in text or s in low for s in self.special):
            return text.split(" ")
        # a capital sigma is the one letter that Python lowers by its place in the word
        if not _ODD.search(text):
            return _PLAIN_PARTS.findall(low)
        return _PARTS.findall(text if "\u03a3" in text else low)

    def encode(self, texts: list[str]) -> list[bytes]:
        young, old = self.memo.young, self.memo.old
        rows, missing = [], set()
        for t in texts:
            ps = self.parts(t)
            got = list(map(young.get, ps))
            if None in got:
                missing.update(p for p, v in zip(ps, got) if v is None)
            rows.append((ps, got))
        found = {p: old[p] for p in missing if p in old}
        new = [p for p in missing if p not in found]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            found.update(zip(part, self.many(part)))
        out = [b"".join([found[p] if v is None else v for p, v in zip(ps, got)] if None in got else got) for ps, got in rows]
        for p, v in found.items():
            self.memo.put(p, v)
        return out


@lru_cache(maxsize=1)
def pieces(spec: str, dtype: str) -> HuggingPieces:
    return HuggingPieces(spec, dtype)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and store that Spark takes it to have, so that executors don't take it for their own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def filesystem(folder: str):
    """The store of a qualified folder as pyarrow sees it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class TokenFile:
    """An open file: its two sequences in memory, ids fetched by document."""

    def __init__(self, folder: str, name: str):
        store, path = filesystem(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size, tail = self.file.size(), struct.calcsize("<QQQQB8s")
        end = self.file.read_at(min(tail, size), max(size - tail, 0))
        if len(end) < tail or end[-8:] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.n_ids, self.n_null, at, mid, self.width, _ = struct.unpack("<QQQQB8s", end)
        self.starts = EliasFano.load(self.file.read_at(mid - at, at))
        rest = self.file.read_at(size - tail - mid, mid)
        self.base, self.keys = struct.unpack_from("<q", rest)[0], EliasFano.load(rest[8:])

    def __len__(self) -> int:
        return self.starts.n

    def key(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.keys.select(i - self.n_null)

    def start(self, i: int) -> int:
        """Ids of the file before document i, which may be the one after the last."""
        return self.starts.select(i) if i < self.starts.n else self.n_ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.start(i), self.start(i + 1))


def write(docs: DataFrame, spec: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> list[dict]:
    """Writes the files and returns the manifest: part, name, n_docs, n_ids, base (ids before it), in key order."""
    folder = qualified(docs.sparkSession, folder)
    model = json.loads(spec)
    top = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    dtype = "<u2" if top < 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t"))
    rows = rows.withColumns({"tie": F.xxhash64("t"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(F.col("k").asc_nulls_first(), "tie", "place").sortWithinPartitions(F.col("k").asc_nulls_first(), "tie").select("k", "t")

    def run(batches):
        enc = pieces(spec, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        part = TaskContext.get().partitionId()
        name, n_ids, keys, starts, n_null = f"part-{part:06d}.ltok", 0, [], [], 0
        store, path = filesystem(folder)
        out = None
        for batch in batches:
            for piece, texts in slices(batch, "t"):
                if out is None:
                    store.create_dir(path, recursive=True)
                    temp = f"{path}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                for k, b in zip(piece.column("k").to_pylist(), enc.encode(texts)):
                    starts.append(n_ids)
                    if k is None:
                        n_null += 1
                    else:
                        keys.append(k)
                    out.write(b + end)
                    n_ids += len(b) // len(end) + 1
        if out is None:
            return
        base = keys[0] if keys else 0
        first = EliasFano.build(np.array(starts)).dump()
        second = struct.pack("<q", base) + EliasFano.build(np.array([k - base for k in keys], dtype=np.uint64)).dump()
        at = n_ids * len(end)
        out.write(first + second + struct.pack("<QQQQB8s", n_ids, n_null, at, at + len(first), len(end), MAGIC))
        out.close()
        store.move(temp, f"{path}/{name}")
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(starts), "n_ids": n_ids}])

    found = sorted(text_batches(rows).mapInArrow(run, "part long, name string, n_docs long, n_ids long").collect(), key=lambda r: r.part)
    manifest, base = [], 0
    for r in found:  # one row a file
        manifest.append({**r.asDict(), "base": base})
        base += r.n_ids
    return manifest


def read(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    folder = qualified(spark, folder)
    files = spark.createDataFrame([(m["name"], m["base"]) for m in manifest], "name string, base long").repartition(len(manifest))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(folder, row["name"])
                n, at = len(f), 0
                while at < n:
                    starts = [f.start(at)]
                    while at + len(starts) <= n and len(starts) <= READ_DOCS and starts[-1] - starts[0] < READ_IDS:
                        starts.append(f.start(at + len(starts)))
                    ids = f.ids(starts[0], starts[-1]).astype("<u4")
                    docs = [ids[a - starts[0] : b - starts[0]] for a, b in zip(starts, starts[1:])]
                    keys = [f.key(i) for i in range(at, at + len(docs))]
                    cols = [pa.array(keys, pa.int64()), pa.array(np.array(starts[:-1], np.int64) + row["base"]), pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([d.astype("<i4") for d in docs], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    at += len(docs)

    return files.mapInArrow(run, schema)


def tokenizer_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def query(spark, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_spec(), folder)
    return read(spark, folder, manifest)
