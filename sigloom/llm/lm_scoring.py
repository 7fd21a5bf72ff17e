"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

Two matched bigram models, one of the target documents and one of the whole corpus (the
background), share one vocabulary: every word of the corpus.  Both are

    P(w | h) = b * c(h w) / c(h .) + (1 - b) * (c(w) + a) / (N + a V)

with c(h .) the times h has a successor; the first word of a text, and a word whose
predecessor has no successor in a model, get the unigram part alone.  A document's score
is the mean over its words of -log2 P_target + log2 P_background: low means target-like.

All counts cover all documents.  The distributed dictionary carries each block's distinct
unigrams and bigrams with their counts in the block, in target and background, and
answers with the corpus counts; no count table is broadcast or collected.  Only three
totals (words of either, vocabulary) come to the driver.

N-grams are told apart by the upper 56 bits of their hashes; a collision adds up two
counts, which the smoothing outweighs.

Defined results: null, empty and wordless texts have 0 words and null scores; repeated
rows count as often as they occur; target ids that are null or match no document do
nothing; without target words the target model is uniform over the vocabulary; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SCHEMA = "doc_id long, n_words long, target_bits double, background_bits double, score double"
ASK_SCHEMA = "bucket int, block long, blob binary, target_words long"


#: Target documents up to which their places in the blocks are broadcast (32 MB); beyond, blocks are shuffled to them.
BROADCAST_IDS = 8_000_000
#: Hash bits of an n-gram key; the rest tells unigrams (0) and bigrams (1) apart.
MASK = ~np.uint64(0xFF)


class Grams:
    """Unigram and bigram keys of a block's words, and which of them a text ends with."""

    def __init__(self, texts: list[bytes]):
        self.w = c.Words(texts, fold=c.LOWER)
        at, two = self.w.windows(2)
        self.second = at + 1
        self.n = len(self.w.hash)
        self.keys = np.concatenate([self.w.hash & MASK, (two & MASK) | np.uint64(1)])
        self.owner = np.concatenate([self.w.doc, self.w.doc[at]])
        self.ends = np.zeros(len(self.keys), np.int64)
        some = self.w.count > 0
        self.ends[(self.w.first + self.w.count - 1)[some]] = 1


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, blend: float = 0.7, add: float = 0.1, block_bytes: int = 2 * c.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, target_bits, background_bits (mean per word) and score of every document.

    ``target_ids``: one column, the doc_ids whose texts train the target model.  Words are
    lower-cased (A to Z) and parted by white space.
    """
    grown = c.growth(docs)
    blocks = c.pack_documents(docs, int(block_bytes * grown))
    n = c.n_ranges(blocks, "n_words", 1.2, grown)
    n_words = blocks.agg({"n_words": "sum"}).first()[0] or 0
    ids = target_ids.select(target_ids[target_ids.columns[0]].cast("long").alias("t_id")).where("t_id is not null").distinct()
    places = blocks.select(F.col("block").alias("t_block"), F.posexplode("ids").alias("at", "id"))
    targets = places.join(ids, F.col("id") == F.col("t_id")).groupBy("t_block").agg(F.sort_array(F.collect_list("at")).alias("targets"))
    if ids.count() <= BROADCAST_IDS:  # places of target documents: 4 bytes each
        targets = F.broadcast(targets)
    marked = blocks.join(targets, F.col("block") == F.col("t_block"), "left").drop("t_block")

    def ask(b: pa.RecordBatch) -> pa.Table:
        block = c.Block(b)
        g = Grams(block.texts)
        target = np.zeros(len(block.ids), bool)
        target[b.column("targets").to_pylist()[0] or []] = True
        keys, order, runs, _ = c.distinct(g.keys)
        mine = target[g.owner][order].astype(np.int64)
        ends = g.ends[order]
        # occurrences and text ends, in all texts and in target texts
        counts = [np.add.reduceat(x, runs) for x in (np.ones(len(order), np.int64), mine, ends, ends * mine)] if len(keys) else [keys] * 4
        table = c.rows(list(c.emit(block.block, keys, counts, n)))
        words = np.zeros(table.num_rows, np.int64)
        words[:1] = int(target[g.w.doc].sum())
        return table.append_column("target_words", pa.array(words))

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from ask(b.slice(i, 1)).to_batches()

    def add_up(table: pa.Table) -> pa.Table:
        names, cut, order, runs, run, values = c.merge(table)
        total = [np.add.reduceat(v[order], runs) for v in values]
        offset = c.range_starts(n)[table.column("bucket")[0].as_py()]
        keys = np.concatenate([np.cumsum(c.decode(x)[0]) for x in table.column("blob").to_pylist()])[order][runs] + offset
        vocabulary = int(((keys & ~MASK) == 0).sum())
        bucket = table.column("bucket")[0].as_py()
        found = c.rows([(bucket, names[i], c.encode(*(t[run[cut[i] : cut[i + 1]]] for t in total))) for i in range(len(names))])
        target_words = np.zeros(found.num_rows, np.int64)
        target_words[0] = sum(table.column("target_words").to_pylist())
        vocab = np.zeros(found.num_rows, np.int64)
        vocab[0] = vocabulary
        return found.append_column("target_words", pa.array(target_words)).append_column("vocabulary", pa.array(vocab))

    counts = marked.mapInArrow(each, ASK_SCHEMA).groupBy("bucket").applyInArrow(add_up, ASK_SCHEMA + ", vocabulary long")
    counts = c.materialise(counts)
    totals = counts.agg(F.coalesce(F.sum("target_words"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    n_target, vocabulary = int(totals[0]), max(1, int(totals[1]))

    def finish(b: c.Block, got: dict[int, bytes]) -> pa.Table:
        g = Grams(b.texts)
        m = len(b.ids)
        bits = []
        if g.n:
            index = c.distinct(g.keys)[3]
            for k, total in ((1, n_target), (0, n_words)):
                count, ends = (c.answers_in_order(got, j).astype(np.float64)[index] for j in (k, k + 2))
                uni, two = count[: g.n], count[g.n :]
                history = (uni - ends[: g.n])[g.second - 1]  # times the word before has a successor
                p = (uni + add) / (total + add * vocabulary)
                seen = history > 0
                at = g.second[seen]
                p[at] = blend * two[seen] / history[seen] + (1 - blend) * p[at]
                bits.append(np.bincount(g.w.doc, weights=-np.log2(p), minlength=m))
        else:
            bits = [np.zeros(m), np.zeros(m)]
        some = g.w.count > 0
        mean = [np.divide(x, g.w.count, out=np.zeros(m), where=some) for x in bits]
        columns = [pa.array(b.ids, pa.int64()), pa.array(g.w.count, pa.int64()), *(pa.array(x, mask=~some) for x in (*mean, mean[0] - mean[1]))]
        return pa.table(columns, names=["doc_id", "n_words", "target_bits", "background_bits", "score"])

    return c.answer_blocks(blocks, counts.select("bucket", "block", "blob"), finish, SCHEMA)
