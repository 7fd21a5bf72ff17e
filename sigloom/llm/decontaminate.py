"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows.

The benchmark's windows are hashed into sorted arrays that are broadcast once their size
is known: a slice holds at most ``slice_bytes`` of benchmark text.  A larger benchmark is
dealt into slices by item, and the documents pass by one slice after another; each
slice adds its spans and items to what the document already has.  Spans are cut once, after
the last slice.  Documents are never
shuffled.  A hash hit counts only after the words themselves agree.

Defined results: null or wordless texts have no windows and no hits; an item without
words matches nothing; items with null ids are left out; repeated items count once; empty
tables give zeros or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: ASCII letters (after lower-casing), digits and all non-ASCII bytes make words.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A to Z lower-cased, everything else left.
FOLD = c.LOWER
#: Benchmark text of one broadcast set; a built set takes about ten times as much.
SLICE_BYTES = 16 << 20
CACHE = 50_000
SCAN_BYTES = 2 << 20
SPANS = "array<struct<start:long,end:long>>"
SCHEMA = f"doc_id long, n_words long, n_hit long, spans {SPANS}, item_ids array<string>"


class Grams:
    """Windows of some items as arrays: by length, sorted hashes and the word at which each starts.

    About 10 bytes for a byte of text.  Words and items of a hash are looked up when a
    document hits it; ``CACHE`` looked-up hashes are kept.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int):
        w = c.Words([t.encode() for t in texts], SEPARATORS, FOLD)
        self.ids, self.known = ids, {}
        self.buf, self.start, self.end, self.doc = w.buf, w.start, w.end, w.doc
        at, h = w.windows(window)
        short = np.flatnonzero((w.count > 0) & (w.count < window))
        size = np.append(np.full(len(at), window), w.count[short])
        at, h = np.append(at, w.first[short]), np.append(h, w.whole(short))
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            own = own[np.argsort(h[own], kind="stable")]
            self.found[n] = h[own], at[own]

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def owners(self, n: int, x: int) -> dict[bytes, set[str]]:
        """The items of each phrase of ``n`` words whose hash is ``x``."""
        have = self.known.get((n, x))
        if have is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            hashes, at = self.found[n]
            lo, hi = (np.searchsorted(hashes, np.uint64(x), side) for side in ("left", "right"))
            have = self.known[n, x] = {}
            for i in at[lo:hi].tolist():
                have.setdefault(phrase(self, i, n), set()).add(self.ids[self.doc[i]])
        return have

    def scan(self, texts: list[bytes]) -> tuple[c.Words, np.ndarray, list[set[str]]]:
        """The words, which of them are hit, and the items that hit each text."""
        w = c.Words(texts, SEPARATORS, FOLD)
        edge = np.zeros(len(w.hash) + 1, np.int32)
        items: list[set[str]] = [set() for _ in texts]
        for n, (hashes, _) in self.found.items():
            at, h = w.windows(n)
            place = np.searchsorted(hashes, h)
            hit = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == h)
            for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                owners = self.owners(n, x).get(phrase(w, i, n))
                if owners:
                    edge[i] += 1
                    edge[i + n] -= 1
                    items[w.doc[i]] |= owners
        return w, np.cumsum(edge[:-1]) > 0, items


def phrase(w: c.Words | Grams, i: int, n: int) -> bytes:
    """Words i to i + n - 1, joined by one space."""
    lo = w.start[i]
    raw = w.buf[lo : w.end[i + n - 1]].tobytes()
    return b" ".join(raw[s - lo : e - lo] for s, e in zip(w.start[i : i + n].tolist(), w.end[i : i + n].tolist(), strict=True))


def _slices(benchmark: DataFrame, window: int, slice_bytes: int) -> Iterator[Grams]:
    items = benchmark.select(benchmark["item_id"].cast("string").alias("i"), benchmark["text"].cast("string").alias("t")).where("i is not null and t is not null")
    total, most = items.agg(F.sum(F.octet_length("t")), F.max(F.octet_length("t"))).first()
    if not total:
        return
    n = 1 if total <= slice_bytes else 2 * (total // max(1, slice_bytes - min(most, slice_bytes // 2)) + 1)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        got = part.collect()  # at most about slice_bytes
        if got:
            yield Grams([r.i for r in got], [r.t for r in got], window)


def _batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a list into parts of about SCAN_BYTES."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t or b"")
        if held >= SCAN_BYTES:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word intervals hit) and item_ids of every document.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item.
    """
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("item_ids"))
    empty = True
    previous: DataFrame | None = None
    for grams in _slices(benchmark, window, slice_bytes):
        if previous is not None:
            found = c.materialise(previous)
        previous = _pass(found, grams)
        empty = False
    if empty:
        previous = _pass(found, Grams([], [], window))
    return previous.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"), "spans", "item_ids")


def _pass(docs: DataFrame, grams: Grams) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in _batches(texts):
                w, mask, items = g.scan([t or b"" for t in texts[lo:hi]])
                mask = _marks(w, b.column(2).slice(lo, hi - lo).to_pylist(), mask)
                for d, before in enumerate(b.column(3).slice(lo, hi - lo).to_pylist()):
                    items[d] |= set(before or ())
                start, end = c.intervals(mask, w.doc)
                first = w.first[w.doc[start]] if len(start) else start
                counts = np.array([len(x) for x in items], np.int64)
                yield pa.record_batch(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), c.span_lists(start - first, end - first, np.bincount(w.doc[start], minlength=hi - lo)), c.lists(pa.array([y for x in items for y in sorted(x)], pa.string()), counts), pa.array(w.count, pa.int64())],
                    names=["doc_id", "text", "spans", "item_ids", "n_words"],
                )

    return docs.select("doc_id", "text", "spans", "item_ids").mapInArrow(run, f"doc_id long, text string, spans {SPANS}, item_ids array<string>, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, mode: str = "documents", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs``, all columns, without contaminated documents, or with the hit passages cut out of the text.

    ``mode``: "documents" or "spans" (from the first byte of a hit run's first word to the
    last byte of its last word).  Documents without a hit pass unchanged.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    at = docs.columns.index("text")
    if mode == "spans":
        return _cut_spans(docs, at, benchmark, window, slice_bytes)
    out = docs
    for k, grams in enumerate(_slices(benchmark, window, slice_bytes)):
        out = (c.materialise(out) if k else out).mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(grams), at), docs.schema)
    return out


def _drop(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for lo, hi in _batches(texts):
                w, mask, _ = shared.value.scan([t or b"" for t in texts[lo:hi]])
                yield b.slice(lo, hi - lo).filter(pa.array(np.bincount(w.doc[mask], minlength=hi - lo) == 0))

    return run


def _cut_spans(docs: DataFrame, at: int, benchmark: DataFrame, window: int, slice_bytes: int) -> DataFrame:
    """Slices mark words of the whole text, one after another; what they marked is cut once."""
    marked = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text"), F.lit(None).cast(SPANS).alias("spans"))
    kind = marked.schema
    for k, grams in enumerate(_slices(benchmark, window, slice_bytes)):
        marked = (c.materialise(marked) if k else marked).mapInArrow(_mark(docs.sparkSession.sparkContext.broadcast(grams)), kind)
    return marked.mapInArrow(_cut(at), docs.schema)


def _marks(w: c.Words, spans: list, mask: np.ndarray) -> np.ndarray:
    for d, some in enumerate(spans):
        for s in some or ():
            mask[w.first[d] + s["start"] : w.first[d] + s["end"]] = True
    return mask


def _mark(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in _batches(texts):
                w, mask, _ = shared.value.scan([t or b"" for t in texts[lo:hi]])
                part = b.slice(lo, hi - lo)
                start, end = c.intervals(_marks(w, part.column(2).to_pylist(), mask), w.doc)
                first = w.first[w.doc[start]] if len(start) else start
                spans = c.span_lists(start - first, end - first, np.bincount(w.doc[start], minlength=hi - lo))
                yield pa.record_batch([part.column(0), part.column(1), spans], names=["row", "text", "spans"])

    return run


def _cut(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in _batches(texts):
                part = b.slice(lo, hi - lo)
                w, new = c.Words([t or b"" for t in texts[lo:hi]], SEPARATORS, FOLD), texts[lo:hi]
                for d, some in enumerate(part.column(2).to_pylist()):
                    keep, last = [], 0
                    for s in some or ():
                        a, z = (int(x) for x in (w.start[w.first[d] + s["start"]] - w.begin[d], w.end[w.first[d] + s["end"] - 1] - w.begin[d]))
                        keep.append(new[d][last:a])
                        last = z
                    if some:
                        new[d] = b"".join([*keep, new[d][last:]])
                row = part.column(0)
                columns = [row.field(k) for k in range(row.type.num_fields)]
                columns[at] = pa.array(new, pa.binary()).cast(columns[at].type)
                yield pa.record_batch(columns, names=[row.type.field(k).name for k in range(row.type.num_fields)])

    return run
