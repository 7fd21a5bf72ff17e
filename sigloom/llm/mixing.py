"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each document gets a place in its source's shuffle (md5 of seed and doc_id).  A source
emits its documents in that order, and once more if its target exceeds its size.  The
virtual finish time of a copy is the source's cumulative words divided by its target; all
copies are range-sorted by it and the mix ends where the total budget is reached.

No window holds a whole source: the shuffle key's first hex digits cut every source into
parts, parts are summed, and cumulative sums run over the part sums and then inside each
part.  The cut of the global order works the same way on ranges of finish time.  Text is
read once, to count words; only ids, sources and sizes are shuffled.

Defined results: a null text has size 0; documents of size 0 take part and take 0 words;
null is a source of its own, ordered last; a null doc_id is shuffled as the text "null";
rows alike in all of that are interchangeable; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the finish-time axis, for the global cut.
SLOTS = 4096


def _parts(rows: int) -> int:
    """Hex digits of the shuffle key that cut a source: parts of about 4000 rows if one source holds all."""
    digits = 1
    while 16**digits * 4000 < rows and digits < 8:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """src, source_size, target of each source.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words.  A target stops at ``cap`` times its source's size; the excess goes to
    the others by weight until none is above.  That is one water level: sources ordered by
    the level at which they fill up, the level is the rest of the budget over the rest of
    the weights.  The windows run over one row per source.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("fills", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    below = Window.orderBy(F.col("fills"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    rest = budget - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(below), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    per = per.withColumn("level", rest / open_weight).withColumn("filled", F.col("level") >= F.col("fills"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("fills"), F.col("src").asc_nulls_last())))
    level = F.min(F.when(~F.col("filled"), F.struct("place", "level"))).over(everything)["level"]  # at the first that doesn't fill up
    top = F.lit(float(cap)) * F.col("source_size")
    return per.select("src", "source_size", F.least(top, F.coalesce(F.col("weight") * level, top)).alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("src"), word_count(docs["text"]).alias("size"))


def shuffle_key(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _cumulated(df: DataFrame, group: list[str], part: str, order: list, out: str, value: str) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each row, over parts in order and rows in order."""
    keys = [F.col(g).eqNullSafe(F.col(f"o_{g}")) for g in [*group, part]]
    sums = df.groupBy(*group, part).agg(F.sum(value).alias("part_sum"))
    before = Window.partitionBy(*group).orderBy(part) if group else Window.orderBy(part)
    offsets = sums.select(*[F.col(g).alias(f"o_{g}") for g in [*group, part]], (F.sum("part_sum").over(before) - F.col("part_sum")).alias("offset"))
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    inside = F.sum(value).over(Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("inside", inside).join(offsets, condition).withColumn(out, F.col("offset") + F.col("inside")).drop("offset", "inside", *[f"o_{g}" for g in [*group, part]])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and finish (times of the copies the mix takes, in order).

    One row per document.  ``cap`` is a whole number of copies at most.
    """
    if cap < 1 or cap != int(cap):
        raise ValueError("cap is a whole number of copies")
    base = materialise(document_sizes(docs).withColumn("key", shuffle_key(seed, F.col("doc_id"))))
    digits = _parts(base.count())
    targets = source_targets(base, weights, share, cap)
    targets = materialise(targets.withColumn("t_src", F.col("src")).drop("src"))
    placed = _cumulated(base.withColumn("part", F.substring("key", 1, digits)), ["src"], "part", ["key", "doc_id", "size"], "cum", "size")
    placed = placed.join(targets, F.col("src").eqNullSafe(F.col("t_src"))).drop("t_src", "part")
    # finish time of each copy: sources without a target never finish
    copies = F.transform(F.sequence(F.lit(0), F.lit(int(cap) - 1)), lambda k: F.when(F.col("target") > 0, (k * F.col("source_size") + F.col("cum")) / F.col("target")))
    placed = materialise(placed.withColumn("times", copies))
    # the mix: copies in order of finish time, up to the budget
    queue = placed.select("key", "doc_id", "src", "size", F.explode("times").alias("finish")).where(F.col("finish").isNotNull() & (F.col("size") > 0))
    queue = queue.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(2.0)) * (SLOTS // 2)).cast("int"))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    per_slot = queue.groupBy("slot").agg(F.sum("size").alias("slot_sum"))  # SLOTS + 1 rows at most
    upto = per_slot.withColumn("upto", F.sum("slot_sum").over(Window.orderBy("slot")))
    # the slot in which the budget runs out; all before it are taken whole
    edge_slot = upto.where(F.col("upto") > F.lit(budget)).orderBy("slot").first()
    last_slot = edge_slot.slot if edge_slot else 2**30
    order = [F.col("finish"), F.col("key"), F.col("src").asc_nulls_last(), F.col("size")]
    final = None
    if edge_slot:
        # one slot holds about 1 / SLOTS of the mix; its order is cut into finer parts likewise
        edge = queue.where(F.col("slot") == last_slot).withColumn("fine", F.floor((F.col("finish") * (SLOTS // 2) - F.col("slot")) * SLOTS).cast("int"))
        used = F.lit(edge_slot.upto - edge_slot.slot_sum)
        fits = _cumulated(edge, [], "fine", order, "upto", "size").where(F.col("upto") + used <= F.lit(budget))
        final = fits.agg(F.max(F.struct("finish", "key")).alias("m")).first().m

    def taken(t: Column) -> Column:
        slot = F.floor(F.least(t, F.lit(2.0)) * (SLOTS // 2)).cast("int")
        out = slot < last_slot
        if final:
            out = out | ((slot == last_slot) & ((t < F.lit(final.finish)) | ((t == F.lit(final.finish)) & (F.col("key") <= final.key))))
        return F.coalesce(out, F.lit(False))

    kept = F.when(F.col("size") > 0, F.filter("times", taken)).otherwise(F.expr("cast(array() as array<double>)"))
    out = placed.withColumn("finish", kept)
    return out.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", (F.col("size") * F.size("finish")).cast("long").alias("taken"), "finish")


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, in the order of the mix; a document that it takes twice is there twice.

    Documents of size 0 cost nothing and stay once, at the end.  Documents that share a
    doc_id are told apart by source and size.
    """
    mix = mix_sources(docs, **options).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("finish")))
    times = F.when(F.col("size") > 0, F.col("finish")).otherwise(F.array(F.lit(float("inf"))))
    mix = mix.where("n = 1").select(F.struct("doc_id", "source", "size").alias("mixed"), times.alias("times"))
    identity = F.struct(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"))
    keyed = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("row"), identity.alias("id"))
    joined = keyed.join(mix, F.col("id").eqNullSafe(F.col("mixed"))).select("row", F.explode("times").alias("finish"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(partitions, "finish").sortWithinPartitions("finish").select("row.*")
