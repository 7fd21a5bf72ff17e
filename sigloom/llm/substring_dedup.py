"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Each block of documents sends its distinct window hashes with the smallest doc_id that
holds them; a range of hashes answers whether a smaller doc_id holds the window
elsewhere.  Windows that repeat merge into maximal removal intervals.  Nothing but
hashes (about 7 bytes a window) and answers (1 bit) is shuffled besides the compressed
blocks, and a passage found in a third of all documents is one entry per block.

Two different windows are taken for the same only if their 64-bit hashes collide.

Defined results: a null text has no words; an empty text or one shorter than the window
loses nothing; documents with the same doc_id don't remove each other's windows; a null
doc_id counts as larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def kept_texts(w: c.Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    n = len(w.begin)
    edge = np.zeros(len(w.buf) + 1, np.int8)
    edge[w.start[keep]] += 1
    edge[w.end[keep] + 1] -= 1  # with the separator after the word
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    flat = np.where(c.SPACES[w.buf], np.uint8(0x20), w.buf)[mask].tobytes()
    size = np.zeros(n, np.int64)
    np.add.at(size, w.doc[keep], w.end[keep] - w.start[keep] + 1)
    to = np.cumsum(size)
    return [flat[e - s : e - 1] if s else b"" for s, e in zip(size.tolist(), to.tolist(), strict=True)]


def remove_repeated_windows(docs: DataFrame, window: int = 50, block_bytes: int = c.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word intervals removed) and kept_text of every document.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id.  Windows are judged on the input.
    """
    grown = c.growth(docs)
    blocks = c.pack_documents(docs, int(block_bytes * grown))
    n = c.n_ranges(blocks, "n_words", grown=grown)

    def ask(b: c.Block) -> pa.Table:
        w = c.Words(b.texts)
        at, h = w.windows(window)
        keys, order, runs, _ = c.distinct(h)
        first = np.minimum.reduceat(b.rank[w.doc[at]][order], runs) if len(keys) else np.zeros(0, np.uint64)
        low = first.min() if len(first) else np.uint64(0)
        return c.rows([(k, x, low.item().to_bytes(8, "little") + blob) for k, x, blob in c.emit(b.block, keys, [first - low], n)])

    def earlier(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        bare = table.set_column(table.schema.get_field_index("blob"), "blob", pa.array([x[8:] for x in blobs], pa.binary()))
        names, cut, order, runs, run, (first,) = c.merge(bare)
        first = first + np.repeat(np.array([int.from_bytes(x[:8], "little") for x in blobs], np.uint64), np.diff(cut))
        least = np.minimum.reduceat(first[order], runs)
        lost = first > least[run]
        bucket = table.column("bucket")[0].as_py()
        return c.rows([(bucket, names[i], c.encode([cut[i + 1] - cut[i]], np.packbits(lost[cut[i] : cut[i + 1]]))) for i in range(len(names))])

    def finish(b: c.Block, got: dict[int, bytes]) -> pa.Table:
        w = c.Words(b.texts)
        at, h = w.windows(window)
        gone = np.zeros(len(w.hash), bool)
        if len(h):
            _, order, runs, index = c.distinct(h)
            bits = [c.decode(got[k]) for k in sorted(got)]
            lost = np.concatenate([np.unpackbits(x.astype(np.uint8))[: int(m[0])] for m, x in bits]).astype(bool)
            rank = b.rank[w.doc[at]]
            here = np.minimum.reduceat(rank[order], runs)
            hit = at[lost[index] | (rank > here[index])]
            edge = np.zeros(len(w.hash) + 1, np.int32)
            edge[hit] += 1
            edge[hit + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
        start, end = c.intervals(gone, w.doc)
        per = np.bincount(w.doc[start], minlength=len(b.ids))
        lost_words = np.bincount(w.doc[gone], minlength=len(b.ids))
        offset = w.first[w.doc[start]] if len(start) else np.zeros(0, np.int64)
        kept = pa.array(kept_texts(w, np.flatnonzero(~gone)), pa.binary()).cast(pa.string())
        return pa.table(
            [pa.array(b.ids, pa.int64()), pa.array(w.count, pa.int64()), pa.array(lost_words, pa.int64()), c.span_lists(start - offset, end - offset, per), kept],
            names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
        )

    asked = c.over_blocks(blocks, ask)
    answers = asked.groupBy("bucket").applyInArrow(earlier, c.BLOB_SCHEMA)
    return c.answer_blocks(blocks, answers, finish, SCHEMA)
