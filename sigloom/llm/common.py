"""Shared building blocks: packed document blocks, token kernels and a distributed dictionary.

*Packed blocks.*  ``pack_documents`` turns (doc_id, text) rows into rows of about
``block_bytes`` of text, compressed, and writes them to the checkpoint folder.  A block
is then a fixed unit of work: it has the same documents in every later pass, whatever
happens to the partitions or the executors.

*Dictionary.*  Operators that need a fact about every n-gram of a corpus (its first
document, its count) send each block's sorted distinct 64-bit hashes, delta coded, to a
range of hashes (``emit``); one task per range merges the sorted runs (``merge``) and
answers each block in the order in which it asked.  An n-gram costs about 5 bytes on
the wire, one row per (block, range) travels, and a hash that occurs in a third of all
documents is one entry per block, so no key is hot.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text in a block, and dictionary entries (counted before blocks merge) in a range of hashes, up to ...
BLOCK_BYTES = 4 << 20
RANGE_ENTRIES = 2_000_000
#: ... this much input.  Beyond, both grow with its square root, or the pieces that blocks
#: send to ranges would shrink to nothing.
FULL_BYTES = 128 << 30
NO_ID = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, n_words long, ids array<long>, lens array<int>, data binary"
BLOB_SCHEMA = "bucket int, block long, blob binary"
BLOB_TYPE = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- checkpoints


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder; later reads don't recompute it.

    The folder is the one the session names (spark.checkpoint.dir).  Only where the
    session names none, as in tests, is a temporary folder set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- packed blocks


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 16, 0
        ids: list = []
        texts: list = []
        held = 0

        def flush():
            lens = [-1 if t is None else len(t) for t in texts]
            data = b"".join(t for t in texts if t)
            raw = SPACES[np.frombuffer(b" " + b" ".join(t for t in texts if t), np.uint8)]
            words = int(np.count_nonzero(~raw[1:] & raw[:-1]))
            return pa.record_batch(
                [pa.array([x], t) for x, t in ((base + seq, pa.int64()), (len(ids), pa.int64()), (len(data), pa.int64()), (words, pa.int64()), (ids, pa.list_(pa.int64())), (lens, pa.list_(pa.int32())), (_zip(data), pa.binary()))],
                names=["block", "n_docs", "n_bytes", "n_words", "ids", "lens", "data"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += 16 + len(t or b"")
                if held >= block_bytes:
                    yield flush()
                    ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    return run


def growth(df: DataFrame, full: float = FULL_BYTES) -> float:
    """How much larger blocks and ranges are for this input: the size is Catalyst's estimate, no job runs."""
    size = float(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    if size > 1e17:  # unknown: a plan without statistics
        size = float(df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) / 2
    return max(1.0, min(64.0, (size / full) ** 0.5))


def pack_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents (``BLOCK_SCHEMA``), written to the checkpoint folder.

    Only doc_id and text are read; other columns, whatever their names, are ignored.  A
    document larger than ``block_bytes`` is a block of its own.
    """
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialise(src.mapInArrow(_pack(block_bytes), BLOCK_SCHEMA))


@functools.cache
def lean() -> None:
    """Large arrays of this worker go back to the system when they are freed.

    glibc otherwise raises its threshold with every large array that is freed and then
    keeps arrays of up to 32 MB on a heap that doesn't shrink; Arrow's pool keeps its own.
    """
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


class Block:
    """The documents of one packed row: ids (None where null), rank (ids in order, as unsigned), texts."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        lean()
        row = table.slice(0, 1).to_pydict()
        self.block = row["block"][0]
        self.ids = row["ids"][0]
        self.rank = np.array([int(NO_ID) if i is None else i + (1 << 63) for i in self.ids], np.uint64)
        data, at, self.texts, self.null = _unzip(row["data"][0]) if row["n_bytes"][0] else b"", 0, [], []
        for n in row["lens"][0]:
            self.texts.append(data[at : at + max(n, 0)])
            self.null.append(n < 0)
            at += max(n, 0)


# ---------------------------------------------------------------- hashes

_POWERS: dict[int, tuple[np.ndarray, ...]] = {}
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The second modulus, 2**61 - 1.
PRIME = (1 << 61) - 1
_P, _61, _32, _29, _LOW32, _LOW29 = (np.uint64(x) for x in (PRIME, 61, 32, 29, 0xFFFFFFFF, 0x1FFFFFFF))
#: Elements of a product at a time, so that its terms stay in the processor's cache.
PRODUCT_STEP = 1 << 14


def fold61(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, element by element; both are below it."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), PRODUCT_STEP):
        x, y = a[i : i + PRODUCT_STEP], b[i : i + PRODUCT_STEP]
        x1, x0, y1, y0 = x >> _32, x & _LOW32, y >> _32, y & _LOW32
        low, mid = x0 * y0, x1 * y0 + x0 * y1
        total = ((x1 * y1) << np.uint64(3)) + (mid >> _29) + ((mid & _LOW29) << _32) + (low & _P) + (low >> _61)
        out[i : i + PRODUCT_STEP] = fold61(total)
    return out


def _powers61(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        m = min(n, size - n)
        out[n : n + m] = times(out[:m], np.full(m, pow(base, n, PRIME), np.uint64))
        n += m
    return out


def powers(base: int, n: int) -> list[np.ndarray]:
    """base**i and its inverse modulo 2**64, and both modulo PRIME, for i below n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down), _powers61(base % PRIME, size), _powers61(pow(base, -1, PRIME), size)
        if size <= 1 << 23:
            _POWERS[base] = have
    return [x[:n] for x in have]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp prefix sums of values[i] * base**i below j, modulo 2**64 and modulo PRIME.

    Modulo a power of two alone, a Thue-Morse string and its complement agree for every base.
    """
    up, _, up61, _ = powers(base, len(values))
    wrapped, prime = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=wrapped[1:])
    terms = times(fold61(values), up61)
    high, low = np.cumsum(terms >> _32), np.cumsum(terms & _LOW32)  # exact below 2**32 terms
    prime[1:] = fold61((high >> _29) + ((high & _LOW29) << _32) + fold61(low))
    return wrapped, prime


def short_hash(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every ``size`` consecutive values; for a filter, as only short strings are safe."""
    up, down, _, _ = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])


def spans_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64 bits of both residues of each span."""
    wrapped, prime = sums
    _, down, _, down61 = powers(base, len(wrapped))
    residue = times(fold61(prime[end] + (_P - prime[start])), down61[start])
    return (wrapped[end] - wrapped[start]) * down[start] + mix(residue)


#: Keeps the first k bytes of a little-endian chunk of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 256


def byte_strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span; raw goes on for 8 bytes after the last end.

    Spans are read in chunks of eight bytes, each mixed into what came before, so that no
    algebra of the bytes makes two strings agree.
    """
    raw = np.ascontiguousarray(raw)
    chunks = np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=raw, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) * np.uint64(WORD_BASE)
    now = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        now = now[length[now] > k]
        if not len(now):
            break
        piece = chunks[start[now] + k] & _FIRST[np.minimum(length[now] - k, 8)]
        h[now] = mix(h[now] ^ piece) + np.uint64(BYTE_BASE)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


class Words:
    """Words of some texts: start and end in ``buf``, doc (index of the text) and a 64-bit hash.

    ``separators`` marks the bytes that part words; ``fold`` maps bytes before hashing.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, fold: np.ndarray | None = None, step: int = 1 << 15):
        raw = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        self.begin = 1 + np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end_of = self.begin + lens
        if fold is not None:
            raw = fold[raw]
        gap = separators[raw]
        self.buf = raw
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(self.start)
        self.doc = (np.searchsorted(self.begin, self.start, side="right") - 1).astype(np.int32)
        self.hash = np.empty(n, np.uint64)
        for i in range(0, n, step):
            self.hash[i : i + step] = byte_strings(raw, self.start[i : i + step], self.end[i : i + step])
        self.first = np.searchsorted(self.doc, np.arange(len(texts)), side="left")
        self.count = np.searchsorted(self.doc, np.arange(len(texts)), side="right") - self.first

    @functools.cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return prefix_sums(self.hash, WORD_BASE)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word that starts ``size`` words of one text, and the Rabin-Karp hash of those words."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return at, mix(spans_hash(self.sums, at, at + size, WORD_BASE) + np.uint64(size))

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """The hash that ``windows`` would give to all words of each of the given texts."""
        a, n = self.first[docs], self.count[docs]
        return mix(spans_hash(self.sums, a, a + n, WORD_BASE) + n.astype(np.uint64))


# ---------------------------------------------------------------- byte strings of numbers


def encode(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as byte planes, compressed."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, dtype=np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        parts += [struct.pack("<QB", len(a), width), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return _zip(b"".join(parts))


def decode(blob: bytes) -> list[np.ndarray]:
    data, at, out = _unzip(blob), 1, []
    for _ in range(data[0]):
        n, width = struct.unpack_from("<QB", data, at)
        at += 9
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.reshape(-1).view(np.uint64) if n else np.zeros(0, np.uint64))
        at += n * width
    return out


def range_starts(n: int) -> np.ndarray:
    return np.array([((b << 64) + n - 1) // n for b in range(n)], np.uint64)


def rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[k] for x in found], f.type) for k, f in enumerate(BLOB_TYPE)], schema=BLOB_TYPE)


def emit(block: int, keys: np.ndarray, values: list[np.ndarray], n: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, block, blob) of sorted distinct keys and a few numbers for each."""
    starts = range_starts(n)
    cut = np.append(np.searchsorted(keys, starts), len(keys))
    for b in np.flatnonzero(cut[1:] > cut[:-1]):
        k = keys[cut[b] : cut[b + 1]] - starts[b]
        yield int(b), block, encode(np.diff(k, prepend=np.uint64(0)), *(v[cut[b] : cut[b + 1]] for v in values))


def merge(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """One range's blobs: block of each, its cut points, order by key, start of each key's run, run of each entry, values."""
    lean()
    blocks, blobs = table.column("block").to_pylist(), table.column("blob").to_pylist()
    parts = [decode(x) for x in blobs]
    cut = np.cumsum([0, *(len(p[0]) for p in parts)])
    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
    values = [np.concatenate(v) for v in zip(*(p[1:] for p in parts), strict=True)]
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    sorted_keys = keys[order]
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(new) - 1
    return blocks, cut, order, np.flatnonzero(new), run, values


def n_ranges(blocks: DataFrame, column: str, factor: float = 1.0, grown: float = 1.0) -> int:
    total = blocks.agg(F.sum(column)).first()[0] or 0
    return max(8, int(total * factor / (RANGE_ENTRIES * grown)) + 1)


def over_blocks(blocks: DataFrame, run, schema: str = BLOB_SCHEMA) -> DataFrame:
    """``run(Block)`` gives tables; one task holds one block at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from run(Block(b.slice(i, 1))).to_batches()

    return blocks.mapInArrow(each, schema)


def answer_blocks(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(Block, {range: blob})`` gives each block's table from the answers it got."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
        return run(Block(left), got)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, schema)


def answers_in_order(got: dict[int, bytes], k: int = 0) -> np.ndarray:
    """The answers to a block's sorted keys, all ranges in order."""
    return np.concatenate([decode(got[b])[k] for b in sorted(got)]) if got else np.zeros(0, np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys; the order that sorts; where each key's run starts in it; each entry's index among the distinct."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    return s[at], order, at, index


def intervals(mask: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``mask`` within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cont = mask[1:] & mask[:-1] & (doc[1:] == doc[:-1])
    return np.flatnonzero(mask & ~np.append(False, cont)), np.flatnonzero(mask & ~np.append(cont, False)) + 1


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def span_lists(start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> pa.Array:
    both = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], fields=list(SPAN))
    return lists(both, counts)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        materialise(spark.range(0))  # sets the folder
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
