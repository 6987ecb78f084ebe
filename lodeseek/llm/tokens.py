"""Byte-level BPE over the ranks of a vocabulary file, and what the tokenising operators share."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

#: What an id makes with others that it makes nothing with.
NO_PAIR: dict[int, int] = {}
#: Texts are handed on in slices of at most this many UTF-8 bytes (or one text).
SLICE_BYTES = 4 << 20
#: What Spark sends a worker at once: see text_batches().
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Entries of each of the two generations of a worker's memo of pieces, and of those of line starts and of pre-tokens.
MEMO_ENTRIES = 300_000
FEW_ENTRIES = 30_000
#: Longer pieces are encoded without a place in the memo.
MEMO_PIECE = 64


# Letters and numbers that Unicode has assigned after its version 16, whose classes the BPE contract
# uses. The regex module may know later versions; these code points are no letters or numbers to the tokenizer.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


FIRST_NEWER = chr(int(NEWER.split()[0], 16))


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with the classes of letters and numbers of Unicode 16."""
    newer = "".join("-".join(rf"\U{int(x, 16):08X}" for x in part.split("-")) for part in NEWER.split())
    for c in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(c, f"[{c}--[{newer}]]")
    return regex.compile(f"(?V1){pattern}")


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one small integer a bucket.

    A bucket of several keys stores the seed that sends all of them to free slots, a bucket of
    one key the slot itself (negative). Keys that aren't in the set land on some slot, so the
    caller compares the key kept there.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = max(1, n // 2)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, k in enumerate(keys):
            buckets[xxhash.xxh64_intdigest(k, 0) % self.m].append(i)
        seeds, slots = [0] * self.m, [-1] * n
        for b in sorted((b for b in range(self.m) if len(buckets[b]) > 1), key=lambda b: -len(buckets[b])):
            seed = 1
            while True:
                at = [xxhash.xxh64_intdigest(keys[i], seed) % n for i in buckets[b]]
                if len(set(at)) == len(at) and all(slots[x] < 0 for x in at):
                    break
                seed += 1
            seeds[b] = seed
            for i, x in zip(buckets[b], at):
                slots[x] = i
        free = iter([x for x in range(n) if slots[x] < 0])
        for b in range(self.m):
            if len(buckets[b]) == 1:
                x = next(free)
                slots[x], seeds[b] = buckets[b][0], -x - 1
        self.seeds, self.order = seeds, slots
        self.keys = [keys[i] for i in slots]

    def slot(self, key: bytes) -> int:
        """The slot that holds the key, -1 if none does."""
        if not self.n:
            return -1
        s = self.seeds[xxhash.xxh64_intdigest(key, 0) % self.m]
        x = -s - 1 if s < 0 else xxhash.xxh64_intdigest(key, s) % self.n
        return x if self.keys[x] == key else -1


class Codec:
    """Encodes and decodes by the ranks of a vocabulary, each match of a pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.plain, self.pattern = regex.compile(pattern), compiled(pattern)  # the first is faster and does below FIRST_NEWER
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.rank_at = [ranks[k] for k in self.hash.keys]
        # ids of single bytes, and for each id the lookup of what it makes with the id to its right
        self.bytes = [ranks.get(bytes((i,)), -1) for i in range(256)]
        pairs: dict[int, dict[int, int]] = {}
        for k, r in ranks.items():
            for i in range(1, len(k)):
                left, right = ranks.get(k[:i]), ranks.get(k[i:])
                if left is not None and right is not None:
                    pairs.setdefault(left, {})[right] = r
        self.joins = [pairs.get(i, NO_PAIR).get for i in range(max(ranks.values(), default=-1) + 1)]
        self.tokens = Memo(self.encode_token, FEW_ENTRIES)
        self.lead = Memo(self.encode_piece, FEW_ENTRIES)
        self.spaced = Memo(lambda p: self.encode_piece(" " + p))
        self.line_end = self.encode_token("\n") if ranks else b""

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: a heap of neighbouring pairs over bytes linked both ways. A pair's rank is the id it becomes.

        An entry of the heap is rank and place in one number, a small one for words of up to 64 bytes.
        """
        joins, n = self.joins, len(word)
        ids = list(map(self.bytes.__getitem__, word))
        if min(ids) < 0:
            raise ValueError("a byte is not in the vocabulary")
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = 6 if n <= 64 else 40
        low = (1 << bits) - 1
        pair = [joins[a](b) for a, b in zip(ids, ids[1:])]  # rank of the pair that starts here, if it has one
        pair.append(None)
        heap = [r << bits | i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & low, x >> bits
            if pair[i] != r:
                continue  # one of its parts has been merged since
            j = nxt[i]
            k = nxt[i] = nxt[j]
            ids[i] = r
            pair[j] = pair[i] = None
            if k < n:
                prev[k] = i
                new = pair[i] = joins[r](ids[k])
                if new is not None:
                    heappush(heap, new << bits | i)
            h = prev[i]
            if h >= 0:
                new = pair[h] = joins[ids[h]](r)
                if new is not None:
                    heappush(heap, new << bits | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def encode_token(self, token: str) -> bytes:
        word = token.encode("utf-8", "replace")
        x = self.hash.slot(word)
        return array("i", (self.rank_at[x],) if x >= 0 else self.merge(word)).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers."""
        found = (self.plain if max(piece) < FIRST_NEWER else self.pattern).findall(piece)
        if len(found) == 1:  # it has its place in the memo of pieces
            return self.encode_token(found[0])
        return b"".join([self.spaced(t[1:]) if t[0] == " " and len(t) > 1 else self.tokens(t) for t in found])

    def encode(self, text: str) -> bytes:
        return join_pieces(text, self.lead, self.spaced, self.line_end)


class Decoder:
    """Bytes of ids; an id outside the vocabulary is an error."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.pieces[r] = k
        self.lengths = np.array([len(x or b"") for x in self.pieces], dtype=np.int64)

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            raise ValueError("an id is below 0")
        try:
            return b"".join(map(self.pieces.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None


class Memo:
    """A bounded memo of two generations: full, the younger one becomes the older one."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        self.make, self.entries, self.young, self.old = make, entries, {}, {}

    def __call__(self, key: str):
        v = self.young.get(key)
        if v is None:
            v = self.old.get(key)
            if v is None:
                v = self.make(key)
            self.put(key, v)
        return v

    def put(self, key: str, value) -> None:
        if len(key) <= MEMO_PIECE:
            if len(self.young) >= self.entries:
                self.old, self.young = self.young, {}
            self.young[key] = value

    def all(self, keys: list[str]) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    got[i] = self(keys[i])
        return got


#: White space that doesn't stand alone between other characters.
_CROWDED = re.compile(r"\s\s|\A\s|\s\Z")
#: Before a lone space: no pre-token reaches over this place.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def join_pieces(text: str, lead, spaced: Memo, line_end: bytes) -> bytes:
    """Encodes a text piece by piece and joins the results.

    A pre-token has a space only as its first character, unless it is white space throughout.
    So a text can be cut before each single space that stands between other characters, and a
    single line end between other characters is a pre-token of its own.
    """
    if not text:
        return b""
    if _CROWDED.search(text) is None:
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(lead(first))
            out += spaced.all(rest)
            out.append(line_end)
        return b"".join(out[:-1])
    return b"".join([spaced(p[1:]) if i and p[0] == " " else lead(p) for i, p in enumerate(_CUT.split(text))])


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    """One codec a worker; raw is the text of a rank file."""
    return Codec(ranks_of(raw), pattern)


@lru_cache(maxsize=2)
def decoder(raw: bytes) -> Decoder:
    """One decoder a worker."""
    return Decoder(ranks_of(raw))


def text_batches(rows: DataFrame) -> DataFrame:
    """rows, whose session sends workers Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes from now on.

    Spark has these bounds as settings of a session only. Every operator that hands whole texts to
    Python workers asks for them, so that all of them run alike, whichever comes first; lower
    bounds that are set already stay. They bound memory and change no result.
    """
    conf = rows.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?[0-9]+)b?", conf.get(f"spark.sql.execution.arrow.{name}"))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return rows


def slices(batch: pa.RecordBatch, column: str):
    """The batch in slices of bounded text, with the texts (null: empty) of each."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def int_lists(blobs: list[bytes]) -> pa.Array:
    """list<int32> from the little-endian bytes of each row."""
    ends = np.cumsum([0, *(len(x) >> 2 for x in blobs)]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(blobs))])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)
