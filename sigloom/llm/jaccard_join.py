"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams; two documents link when the Jaccard
similarity of their sets reaches a threshold, compared in whole numbers.

1. A distributed dictionary counts in how many documents each n-gram occurs.  Counts give
   the global n-gram order: rare ones first, then by hash.
2. A document whose repeated n-grams are too few for any partner is done.  Of the others,
   equal sets collapse to one representative, in the block and again by signature.
3. Partners share an n-gram of their prefixes (the first n - ceil(t n) + 1 in global
   order).  Representatives that prefixes connect, directly or through others, form a
   candidate group; no pairs are emitted for that.
4. A group is dealt into parts of about ``PART`` representatives, fewer where they hold
   more than ``PART_TOKENS`` n-grams, and pairs of parts are joined:
   the global order below them is cut into fragments, each fragment's partial overlaps
   are counted on their own (a product of two 0/1 matrices), and the fragments' counts are
   summed per pair.  Every part first meets itself and the group's first part; then only
   representatives that are not yet in the group's largest component meet all parts, so a
   large group of near copies needs one pass and not all pairs of parts.
5. Each join gives the links that connect something new; components of all links are the
   classes.

Everything before step 4 is linear in the text.  Sets are compared by 64-bit hashes.

Defined results: null, empty and wordless texts have an empty set, size 0, and link with
nothing; a text of fewer than ``n`` words is one n-gram, its whole sequence; rows with
equal doc_id count as separate documents that equal sets link; a null doc_id cannot name a
component: it counts as larger than all others and comes out as null.  Extra columns are
never read by name, so any name may occur; very long texts are single blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .components import connected_components

PART = 512
#: N-grams in one part; one document may hold more.
PART_TOKENS = 4 << 20
#: Distinct n-grams in one fragment of the global order, within one join.
FRAGMENT = 4096
#: N-grams, repeats counted, that one join ranks at a time.
ENTRIES = 1 << 20
DOC_SCHEMA = "row_id long, doc_id long, n_shingles long, sig_a long, sig_b long, n_prefix int, text_md5 string, tokens array<long>"
LINK_SCHEMA = "a long, b long"


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, sorted by text and hash."""
    w = c.Words(texts, fold=c.LOWER)
    at, h = w.windows(n)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    doc = np.concatenate([w.doc[at], short.astype(np.int32)])
    key = np.concatenate([h, w.whole(short)])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], key[new]


def needed(n, percent: int):
    """The least overlap that a set of ``n`` needs with any partner."""
    return -(-percent * n // 100)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, fragment: int = FRAGMENT, entries: int = ENTRIES) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right sets, fragment by fragment of the common order.

    Only about ``entries`` n-grams, those of one range of hashes, are ranked at a time.
    """
    which = np.unique(np.concatenate([left, right]))
    place = np.full(len(sets), -1)
    place[which] = np.arange(len(which))
    held = [np.sort(sets[i]) for i in which]
    starts = c.range_starts(sum(map(len, held)) // entries + 1)
    cuts = [np.append(np.searchsorted(x, starts), len(x)) for x in held]
    total = np.zeros((len(left), len(right)), np.float32)
    same = np.array_equal(left, right)
    for k in range(len(starts)):
        pieces = [x[cut[k] : cut[k + 1]] for x, cut in zip(held, cuts, strict=True)]
        tokens, owner = _shared(pieces)
        top = int(tokens[-1]) + 1 if len(tokens) else 0
        for lo in range(0, top, fragment):
            i, j = np.searchsorted(tokens, [lo, lo + fragment])
            segment = np.zeros((len(which), min(fragment, top - lo)), np.float32)
            segment[owner[i:j], tokens[i:j] - lo] = 1
            a = segment[place[left]]
            total += a @ (a if same else segment[place[right]]).T
    return total


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the n-gram, set) of the n-grams that several sets hold, by rank."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, order, runs, index = c.distinct(np.concatenate(sets))
    times = np.bincount(index, minlength=len(names))
    # what one set alone holds overlaps with nothing
    use = times[index] > 1
    ids = np.cumsum(times > 1) - 1
    tokens, owner = ids[index[use]], owner[use]
    by = np.argsort(tokens, kind="stable")
    return tokens[by], owner[by]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def spanning_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what neither ``component`` nor an earlier link connects."""
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    apart = component[a] != component[b]
    a, b = a[apart], b[apart]
    label = np.unique(component, return_inverse=True)[1]
    out = []
    while len(a):
        x, y = label[a], label[b]
        # each component takes its first link to a smaller one; those links form a forest
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        first = np.unique(hi, return_index=True)[1]
        out += list(zip(a[first].tolist(), b[first].tolist(), strict=True))
        parent = np.arange(label.max() + 1)
        parent[hi[first]] = lo[first]
        label = _roots(parent)[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return out


def _join_parts(percent: int):
    """Links between the rows of side 0 and of side 1 (3: both) of one pair of parts."""

    def run(table: pa.Table) -> pa.Table:
        c.lean()
        ids = table.column("rep").to_numpy()
        size = table.column("n_shingles").to_numpy()
        side = table.column("side").to_numpy()
        component = table.column("component").to_numpy()
        sets = [x.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) for x in table.column("tokens")]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = overlaps(sets, left, right).astype(np.int64)
            union = size[left][:, None] + size[right][None, :] - both
            linked = (both > 0) & (100 * both >= percent * union)
            found = [(int(ids[a]), int(ids[b])) for a, b in spanning_links(linked, left, right, component) if a != b]
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _sets_table(docs: DataFrame, n: int, percent: int, block_bytes: int) -> DataFrame:
    grown = c.growth(docs)
    blocks = c.pack_documents(docs, int(block_bytes * grown))
    ranges = c.n_ranges(blocks, "n_words", grown=grown)

    def ask(b: c.Block) -> pa.Table:
        _, key = shingle_sets(b.texts, n)
        keys, order, runs, _ = c.distinct(key)
        return c.rows(list(c.emit(b.block, keys, [np.diff(np.append(runs, len(order)))], ranges)))

    def count(table: pa.Table) -> pa.Table:
        names, cut, order, runs, run, (times,) = c.merge(table)
        total = np.minimum(np.add.reduceat(times[order], runs), 0xFFFF)[run]
        bucket = table.column("bucket")[0].as_py()
        return c.rows([(bucket, names[i], c.encode(total[cut[i] : cut[i + 1]])) for i in range(len(names))])

    def finish(b: c.Block, got: dict[int, bytes]) -> pa.Table:
        doc, key = shingle_sets(b.texts, n)
        df = c.answers_in_order(got)[c.distinct(key)[3]] if len(key) else key
        m = len(b.ids)
        size = np.bincount(doc, minlength=m)
        repeated = np.bincount(doc[df > 1], minlength=m)
        maybe = (size > 0) & (repeated >= needed(size, percent))
        prefix = size - needed(size, percent) + 1 - (size - repeated)
        sig_a, sig_b = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        np.add.at(sig_a, doc, c.mix(key ^ np.uint64(c.BYTE_BASE)))
        np.add.at(sig_b, doc, c.mix(key + np.uint64(c.WORD_BASE)))
        # equal sets of one block send their tokens once
        first: dict[tuple[int, int], int] = {}
        for d in np.flatnonzero(maybe).tolist():
            first.setdefault((int(sig_a[d]), int(sig_b[d])), d)
        sends = np.zeros(m, bool)
        sends[list(first.values())] = True
        use = sends[doc] & (df > 1)
        doc, key, df = doc[use], key[use], df[use]
        order = np.lexsort((key, df, doc))
        tokens = key[order].view(np.int64)
        counts = np.bincount(doc, minlength=m)
        ends = np.append(0, np.cumsum(counts))
        arrays = pa.ListArray.from_arrays(pa.array([None if not s else x for s, x in zip(sends.tolist(), ends[:-1].tolist(), strict=True)] + [int(ends[-1])], pa.int32()), pa.array(tokens, pa.int64()))
        return pa.table(
            [pa.array((b.block << 24) + np.arange(m), pa.int64()), pa.array(b.ids, pa.int64()), pa.array(size, pa.int64()), pa.array(np.where(maybe, sig_a.view(np.int64), 0), pa.int64()), pa.array(np.where(maybe, sig_b.view(np.int64), 0), pa.int64()), pa.array(np.where(maybe, prefix, 0), pa.int32()), pa.array([hashlib.md5(t, usedforsecurity=False).hexdigest() for t in b.texts], pa.string()), arrays],
            names=["row_id", "doc_id", "n_shingles", "sig_a", "sig_b", "n_prefix", "text_md5", "tokens"],
        )

    counts = c.over_blocks(blocks, ask).groupBy("bucket").applyInArrow(count, c.BLOB_SCHEMA)
    return c.materialise(c.answer_blocks(blocks, counts, finish, DOC_SCHEMA))


def _links(sets: DataFrame, reps: DataFrame, percent: int, part: int, part_tokens: int) -> DataFrame:
    """Links (a, b) between representatives (rep: a row_id of ``sets``, n_tokens) that connect all whose sets are similar."""

    def dealt(count, tokens):
        return F.greatest(F.ceil(count / part), F.ceil(tokens / part_tokens)).cast("int")

    prefix = sets.where("tokens is not null").select("row_id", F.expr("slice(tokens, 1, n_prefix)").alias("prefix"))
    prefix = prefix.join(reps, F.col("row_id") == F.col("rep")).select("rep", F.explode("prefix").alias("token"))
    hubs = prefix.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("token", "hub")
    near = prefix.join(hubs, "token").select("rep", "hub").distinct()
    groups = connected_components(near, "rep", "hub").select(F.col("node").alias("rep"), F.col("component").alias("group")).join(reps, "rep")
    parts = groups.groupBy("group").agg(dealt(F.count("*"), F.sum("n_tokens")).alias("parts"))
    groups = groups.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # the one shuffle of whole sets, and only of those that have a candidate
    members = c.materialise(sets.select("row_id", "n_shingles", "tokens").join(groups, F.col("row_id") == F.col("rep")).drop("row_id"))
    # every part meets itself and part 0
    own = members.withColumn("component", F.col("rep")).withColumn("other", F.explode(F.expr("case when part = 0 then sequence(0, parts - 1) else array(part) end")))
    own = own.withColumn("side", F.when(F.col("other") != F.col("part"), 1).otherwise(3))
    first = c.materialise(own.groupBy("group", "other").applyInArrow(_join_parts(percent), LINK_SCHEMA))
    large = members.where("parts > 1")
    if large.isEmpty():
        return first
    # of the large groups, what is outside the largest component meets everything
    joined = connected_components(first, "a", "b")
    state = large.join(joined, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    counts = state.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    top = F.struct("n", "component")
    largest = counts.groupBy("group").agg(F.max_by("component", top).alias("largest"), (F.sum("n") - F.max("n")).alias("outside"), (F.sum("tokens") - F.max_by("tokens", top)).alias("outside_tokens"))
    state = c.materialise(state.join(largest.where("outside > 0"), "group").withColumn("queries", dealt(F.col("outside"), F.col("outside_tokens"))))
    columns = ["group", "query", "other", "rep", "n_shingles", "tokens", "component", "side"]
    left = state.where("component != largest").withColumn("query", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("queries")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0)).select(columns)
    right = state.withColumn("other", F.col("part")).withColumn("query", F.explode(F.sequence(F.lit(0), F.col("queries") - 1))).withColumn("side", F.lit(1)).select(columns)
    meets = left.unionByName(right)
    second = meets.groupBy("group", "query", "other").applyInArrow(_join_parts(percent), LINK_SCHEMA)
    return first.union(second)


def _placed(docs: DataFrame, n: int, percent: int, block_bytes: int, part: int, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_shingles, text_md5, root and component_id of every document; root is null where nothing can link."""
    sets = _sets_table(docs, n, percent, block_bytes)
    named = sets.withColumn("name", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    classes = named.where("n_prefix > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("row_id").alias("rep"), F.min("name").alias("least"), F.max(F.size("tokens")).alias("n_tokens"))
    classes = c.materialise(classes)
    links = c.materialise(_links(sets, classes.select("rep", "n_tokens"), percent, part, part_tokens))
    joined = connected_components(links, "a", "b")
    # a class's component is named by the smallest doc_id in it
    placed = classes.select("rep", "least", F.col("sig_a").alias("c_a"), F.col("sig_b").alias("c_b"), F.col("n_shingles").alias("c_n")).join(joined, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(names, "root").select("c_a", "c_b", "c_n", "root", "component_id")
    rest = named.where("n_prefix <= 0").select("doc_id", "n_shingles", "text_md5", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    found = named.where("n_prefix > 0").join(placed, (F.col("sig_a") == F.col("c_a")) & (F.col("sig_b") == F.col("c_b")) & (F.col("n_shingles") == F.col("c_n")))
    return found.select("doc_id", "n_shingles", "text_md5", "root", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")).alias("component_id")).union(rest)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, block_bytes: int = c.BLOCK_BYTES, part: int = PART, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every document.

    Two documents link when 100 * intersection >= ``percent`` * union of their n-gram sets.
    """
    return _placed(docs, n, percent, block_bytes, part, part_tokens).select("doc_id", "n_shingles", "component_id")


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component: smallest doc_id (null last), then smallest MD5 of the text.

    Of rows that repeat both, the one whose columns come first as JSON stays.  Documents
    without words, and those that nothing can link with, have no component but their own
    and all stay, repeated or not.
    """
    placed = _placed(docs, n, percent, c.BLOCK_BYTES, PART).select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("name"), F.col("doc_id").isNull().alias("unnamed"), "text_md5", "root")
    key = F.struct("unnamed", "name", "text_md5")
    alike = placed.where("root is not null").groupBy("root", key.alias("kept_key")).agg(F.count("*").alias("kept_rows"))
    first = alike.groupBy("root").agg(F.min(F.struct("kept_key", "kept_rows")).alias("first"))
    keep = first.select("first.*").union(placed.where("root is null").select(key, F.lit(1).cast("long")).distinct())
    own = F.struct(docs["doc_id"].cast("long").isNull().alias("unnamed"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("name"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")).alias("text_md5"))
    found = docs.select(F.struct("*").alias("row"), own.alias("own_key")).join(keep, F.col("own_key") == F.col("kept_key"))
    # only rows that repeat id and text are numbered; the sort keeps one a task before it shuffles
    place = F.row_number().over(Window.partitionBy("own_key").orderBy(F.to_json("row"), F.xxhash64("own_key")))
    again = found.where("kept_rows > 1").withColumn("place", place).where("place = 1")
    return found.where("kept_rows = 1").select("row.*").unionByName(again.select("row.*"))
