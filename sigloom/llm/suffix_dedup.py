"""Suffix-array dedup: longest-previous-factor arrays over the places that can repeat.

1. Each text, as UTF-8 bytes, is cut into runs of window starts that share a minimizer:
   the place inside the window of the 32-byte string with the smallest hash.  Equal windows have equal
   minimizers, so a window can repeat only if its minimizer does.  A distributed
   dictionary counts the minimizers; what occurs once is left alone.
2. The text below the other runs (segments) goes to a range of minimizer hashes.  Equal
   segments collapse to the first, within the block and again in the range, so a passage
   that a third of all documents hold travels once per block.  Runs of a minimizer that
   occurs more than ``hot`` times are cut into single windows, spread by their own hash.
3. Each range sorts the suffixes that start a window (prefix doubling to ``min_len``
   bytes).  The previous and the next smaller position in suffix order, and the common
   prefixes with them, give the array of longest previous factors; a window whose factor
   reaches ``min_len`` has an earlier match and is removed, the first copy stays.
4. Removed windows merge into intervals per document.

Equal segments are recognised by length and 64-bit hash; suffixes are compared byte by byte.

Defined results: a null text counts as empty; texts shorter than ``min_len`` lose
nothing; rows with equal doc_id are ordered as they are stored; a null doc_id counts as
larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
GRAM = 32
#: Segment bytes that one range should hold before equal ones collapse.
RANGE_BYTES = 4 << 20
#: Smaller than elsewhere: the passes hold several numbers for every byte of a block.
BLOCK_BYTES = 3 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Runs:
    """Runs of window starts with one minimizer, by position in the block's joined bytes."""

    def __init__(self, b: c.Block, min_len: int):
        self.raw = np.frombuffer(b"".join(b.texts), np.uint8)
        lens = np.array([len(t) for t in b.texts], np.int64)
        self.begin = np.append(0, np.cumsum(lens))
        starts, keys, sizes = [], [], []
        group: list[int] = []
        held = 0
        for d in np.flatnonzero(lens >= min_len).tolist() + [-1]:
            if group and (d < 0 or d != group[-1] + 1 or held + lens[d] > 1 << 20):
                lo, hi = self.begin[group[0]], self.begin[group[-1] + 1]
                at = np.arange(hi - lo - GRAM + 1)
                gram = c.short_hash(c._TABLE[self.raw[lo:hi]], GRAM, c.BYTE_BASE)
                # smallest by the upper half of the hash, then leftmost; the lower half holds the position
                least = _sliding_min((gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), min_len - GRAM + 1) & np.uint64(0xFFFFFFFF)
                doc = np.repeat(np.arange(len(group), dtype=np.int32), lens[group])
                ok = doc[: len(least)] == doc[min_len - 1 :]
                new = ok.copy()
                new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
                s = np.flatnonzero(new)
                last = ok.copy()
                last[:-1] &= new[1:] | ~ok[1:]
                e = np.flatnonzero(last) + 1
                starts.append(s + lo)
                keys.append(c.mix(gram[least[s].astype(np.int64)]))  # mixed again: smallest hashes are small numbers
                sizes.append(e - s)
                group, held = [], 0
            if d >= 0:
                group.append(d)
                held += int(lens[d])
        none = np.zeros(0, np.int64)
        self.start, self.key, self.size = np.concatenate([none, *starts]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *sizes])

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of each byte string; strings come in order of start and may overlap."""
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 20))))
            lo, hi = start[i], int((start[i:j] + length[i:j]).max())
            sums = c.prefix_sums(c._TABLE[self.raw[lo:hi]], c.BYTE_BASE)
            out[i:j] = c.mix(c.spans_hash(sums, start[i:j] - lo, start[i:j] - lo + length[i:j], c.BYTE_BASE) + length[i:j].astype(np.uint64) * np.uint64(c.WORD_BASE))
            i = j
        return out


def gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the given strings, one after another."""
    to = np.cumsum(length)
    total = int(to[-1]) if len(to) else 0
    kind = np.int32 if max(total, len(raw)) < 1 << 31 else np.int64
    at = np.repeat((start - (to - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return raw[at]


def _dense(keys: np.ndarray) -> np.ndarray:
    return c.distinct(keys)[3].astype(np.uint64)


def smaller_before(v: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Index of the nearest smaller value before each one; -1 where there is none.

    Each entry follows its left neighbours' answers; what is still open after ``rounds``
    climbs a tree of block minima, so that no order of values costs more than a logarithm.
    """
    out = np.arange(len(v)) - 1
    todo = np.flatnonzero(out >= 0)
    for _ in range(rounds):
        todo = todo[v[out[todo]] > v[todo]]
        if not len(todo):
            return out
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
    most = np.iinfo(v.dtype).max
    levels = [v]
    while len(levels[-1]) > 1:
        low = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], most)
        levels.append(np.minimum(low[::2], low[1::2]))
    block, depth, least = out[todo], np.zeros(len(todo), np.int64), v[todo]
    up = np.arange(len(todo))
    for t, low in enumerate(levels):
        up = up[low[block[up]] > least[up]]
        odd = up[block[up] % 2 == 1]
        block[odd] -= 1  # the left sibling may hold one; else neither does
        here = odd[low[block[odd]] < least[odd]]
        depth[here] = t
        up = np.setdiff1d(up, here, assume_unique=True)
        block[up] = block[up] // 2 - 1
        depth[up] = t + 1
        up = up[block[up] >= 0]
        if not len(up):
            break
    for t in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero((depth == t) & (block >= 0))
        low = levels[t - 1]
        right = np.minimum(2 * block[down] + 1, len(low) - 1)
        block[down] = np.where(low[right] < least[down], right, 2 * block[down])
        depth[down] = t - 1
    out[todo] = np.where(block < 0, -1, block)
    return out


def smaller_after(v: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value after each one; ``len(v)`` where there is none."""
    return len(v) - 1 - smaller_before(v[::-1])[::-1]


def longest_previous_factors(raw: np.ndarray, at: np.ndarray, min_len: int) -> np.ndarray:
    """For suffixes at ``at`` (in text order): the longest match with an earlier one of them, ``min_len`` at most.

    Ranks double from 8 bytes on and order the suffixes by ``min_len`` bytes, which each
    needs to have, then by position.  An entry that shares them all with its neighbour
    before has there its previous smaller position, and a longest factor that nothing
    exceeds.  The others, one for each distinct prefix, have the nearest smaller positions
    before and after in suffix order; the longer of the two common prefixes is the factor.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    pad = np.append(raw, np.zeros(8, np.uint8))
    word = np.zeros(len(raw), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | pad[k : len(raw) + k]
    rank, depth = _dense(word), 8
    ranks = [(8, rank.astype(np.uint32))]
    while depth * 2 <= min_len:
        step = np.append(rank[depth:], np.zeros(min(depth, len(rank)), np.uint64))[: len(rank)]
        rank, depth = _dense((rank << np.uint64(32)) | step), depth * 2
        ranks.append((depth, rank.astype(np.uint32)))
    key = (rank[at] << np.uint64(32)) | rank[at + min_len - depth]
    del rank
    order = np.argsort(key, kind="stable")  # suffix array to that depth; equal prefixes by position
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    del key, sorted_key
    out = np.full(len(at), min_len)
    least = order[first]  # smallest position of each distinct prefix
    out[least] = 0
    for other, none in ((smaller_before(least), -1), (smaller_after(least), len(least))):
        has = np.flatnonzero(other != none)
        a, b = at[least[has]], at[least[other[has]]]
        common = np.zeros(len(has), np.int64)
        for d, r in reversed(ranks):
            common += d * (r[a + common] == r[b + common])
        differ = word[a + common] ^ word[b + common]
        for k in range(1, 8):
            common += differ >> np.uint64(64 - 8 * k) == 0
        out[least[has]] = np.maximum(out[least[has]], common)
    return out


def remove_repeated_bytes(docs: DataFrame, min_len: int = 100, hot: int = 50_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal byte intervals removed) and kept bytes of every document.

    A byte goes if a string of ``min_len`` bytes that covers it also starts earlier: in a
    document with a smaller doc_id, or earlier in the same one.  Strings are judged on the input.
    """
    if min_len < 64:
        raise ValueError("min_len must be at least 64: minimizers are strings of 32 bytes")
    width = min_len - GRAM + 1
    grown = c.growth(docs, c.FULL_BYTES / 4)
    blocks = c.pack_documents(docs, int(block_bytes * grown))
    n_count = c.n_ranges(blocks, "n_bytes", 2.0 / width, grown)
    total = blocks.agg({"n_bytes": "sum"}).first()[0] or 0
    n_seg = max(8, int(total / (RANGE_BYTES * grown)) + 1)

    def ask(b: c.Block) -> pa.Table:
        r = Runs(b, min_len)
        keys, order, runs, _ = c.distinct(r.key)
        times = np.diff(np.append(runs, len(order)))
        return c.rows(list(c.emit(b.block, keys, [times], n_count)))

    def count(table: pa.Table) -> pa.Table:
        names, cut, order, runs, run, (times,) = c.merge(table)
        total = np.add.reduceat(times[order], runs)[run]
        seen = (total > 1).astype(np.uint64) + (total > hot)
        bucket = table.column("bucket")[0].as_py()
        return c.rows([(bucket, names[i], c.encode(seen[cut[i] : cut[i + 1]])) for i in range(len(names))])

    def segments(b: c.Block, got: dict[int, bytes]) -> pa.Table:
        r = Runs(b, min_len)
        if not len(r.key):
            return c.rows([])
        seen = c.answers_in_order(got)[c.distinct(r.key)[3]]
        pick = seen == 1
        start, size, key = r.start[pick], r.size[pick], r.key[pick]
        if (seen == 2).any():
            s, z = r.start[seen == 2], r.size[seen == 2]
            single = gather(np.arange(len(r.raw), dtype=np.int32), s, z).astype(np.int64)
            start, size = np.concatenate([start, single]), np.concatenate([size, np.ones(len(single), np.int64)])
            one = r.hashes(single, np.full(len(single), min_len))
            key = np.concatenate([key, one])
            by = np.argsort(start, kind="stable")
            start, size, key = start[by], size[by], key[by]
        length = size + min_len - 1
        doc = np.searchsorted(r.begin, start, side="right") - 1
        content = r.hashes(start, length)
        rank = b.rank[doc]
        order = np.lexsort((start, rank, content))
        same = np.append(False, content[order][1:] == content[order][:-1])
        drop = np.zeros(len(start), bool)
        drop[order] = same
        out = [(int(b.block % n_seg), b.block, b"\0" + c.encode(start[drop], size[drop]))] if drop.any() else []
        keep = np.flatnonzero(~drop)
        to = (key[keep] >> np.uint64(32)) * np.uint64(n_seg) >> np.uint64(32)
        keep = keep[np.argsort(to, kind="stable")]
        to = np.sort(to)
        edge = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else [0]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            k = keep[i:j]
            data = gather(r.raw, start[k], length[k]).tobytes()
            head = c.encode(key[k], content[k], rank[k], start[k], size[k])
            out.append((int(to[i]), b.block, b"\1" + len(head).to_bytes(4, "little") + head + c._zip(data)))
        return c.rows(out)

    def factors(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out, parts, texts = [], [], []
        for block, blob in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if blob[0] == 0:
                out.append((bucket, block, blob[1:]))
            else:
                n = int.from_bytes(blob[1:5], "little")
                parts.append([*c.decode(blob[5 : 5 + n]), np.full(1, block)])
                texts.append(np.frombuffer(c._unzip(blob[5 + n :]), np.uint8))
        if not parts:
            return c.rows(out)
        owner = np.concatenate([np.repeat(p[5], len(p[0])) for p in parts])
        key, content, rank = (np.concatenate([p[k] for p in parts]) for k in range(3))
        start, size = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (3, 4))
        length = size + min_len - 1
        raw, place = np.concatenate(texts), np.cumsum(length) - length
        # the first of equal segments stays; every window of the others has an earlier match
        order = np.lexsort((start, owner, rank, content))
        drop = np.zeros(len(start), bool)
        drop[order] = np.append(False, content[order][1:] == content[order][:-1])
        lost = [(owner[drop], start[drop], size[drop])]
        # of the others, those count whose minimizer has more than one
        left = np.flatnonzero(~drop)
        times = np.bincount(c.distinct(key[left])[3])[c.distinct(key[left])[3]]
        left = left[times > 1]
        left = left[np.lexsort((start[left], owner[left], rank[left]))]
        if len(left):
            text = gather(raw, place[left], length[left])
            ends = np.cumsum(length[left])
            at = gather(np.arange(len(text), dtype=np.int32), ends - length[left], size[left]).astype(np.int64)
            hit = np.flatnonzero(longest_previous_factors(text, at, min_len) >= min_len)
            seg = np.repeat(np.arange(len(left)), size[left])
            inside = at - np.repeat(ends - length[left], size[left])
            where = start[left][seg[hit]] + inside[hit]
            lost.append((owner[left][seg[hit]], where, np.ones(len(hit), np.int64)))
        who, begin, many = (np.concatenate(x) for x in zip(*lost, strict=True))
        order = np.lexsort((begin, who))
        who, begin, many = who[order], begin[order], many[order]
        # neighbours become one entry
        new = np.append(True, (who[1:] != who[:-1]) | (begin[1:] != begin[:-1] + many[:-1])) if len(who) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        who, begin, many = who[first], begin[first], np.add.reduceat(many, first) if len(first) else many
        edge = np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who)) if len(who) else [0]
        return c.rows(out + [(bucket, int(who[i]), c.encode(begin[i:j], many[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b = c.Block(left)
        raw = np.frombuffer(b"".join(b.texts), np.uint8)
        lens = np.array([len(t) for t in b.texts], np.int64)
        begin = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        edge = np.zeros(len(raw) + 1, np.int32)
        for blob in right.column("blob").to_pylist():
            start, size = (x.astype(np.int64) for x in c.decode(blob))
            np.add.at(edge, start, 1)
            np.add.at(edge, start + size + min_len - 1, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        s, e = c.intervals(gone, doc)
        d = doc[s]
        kept_len = lens - np.bincount(doc[gone], minlength=len(lens))
        kept = raw[~gone].tobytes()
        ends = np.cumsum(kept_len)
        return pa.table(
            [pa.array(b.ids, pa.int64()), pa.array(lens, pa.int64()), pa.array(lens - kept_len, pa.int64()), c.span_lists(s - begin[d], e - begin[d], np.bincount(d, minlength=len(lens))), pa.array([kept[y - x : y] for x, y in zip(kept_len.tolist(), ends.tolist(), strict=True)], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    counts = c.over_blocks(blocks, ask).groupBy("bucket").applyInArrow(count, c.BLOB_SCHEMA)
    found = c.answer_blocks(blocks, counts, segments, c.BLOB_SCHEMA)
    lost = found.groupBy("bucket").applyInArrow(factors, c.BLOB_SCHEMA)
    return blocks.groupBy("block").cogroup(lost.groupBy("block")).applyInArrow(finish, SCHEMA)
