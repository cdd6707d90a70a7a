"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Van der Corput points are mapped through the cumulative target weights: point t gives slot t of the mix to the source
whose interval holds it.  Slots are ranked for each source; each source's shuffled, repeated stream of words is cut into
blocks of equally many words, and block r fills the source's slot of rank r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import WORD, settle

#: Words of a block.
BLOCK = 64
#: Most sources for which the table of sources is broadcast; with more, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Consecutive points or slots that one task handles together.
RUN = 1 << 16
#: Tasks that make the schedule, at most: one for each run of points up to that.
MOST_TASKS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """``sources`` (source, source_size long, weight) with ``target``: shares of all sizes by weight, at most ``cap``
    times the source's size; the excess is shared again by weight until no target is above.  One row for each source."""
    full = F.col("source_size").cast("double") * cap
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    order = W.partitionBy().orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    capped_before = F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    out = sources.withColumns({"_full": full, "_total": total, "_capped": full * weight_left <= F.col("weight") * (total - capped_before)})
    rest = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_full")).otherwise(0.0)).over(W.partitionBy())
    open_weight = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(W.partitionBy())
    share = F.col("weight") * rest / F.when(open_weight == 0, F.lit(None)).otherwise(open_weight)
    return out.withColumn("target", F.when(F.col("_capped"), F.col("_full")).otherwise(F.coalesce(share, F.lit(0.0)))).drop("_full", "_total", "_capped")


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of x in reverse order: the van der Corput sequence in base 2, times 2 ** bits."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(m), step).bitwiseOR(F.shiftrightunsigned(x, step).bitwiseAND(m))
    return F.shiftrightunsigned(x, 64 - bits) if bits else x * 0


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(sid, slot, rank) for slots 0 to ``slots`` - 1: the source of each, and its rank among that source's slots."""
    bits = max(1, (max(slots, 1) - 1).bit_length())
    cumulated = F.sum("target").over(W.partitionBy().orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    share = lambda x: F.greatest(F.lit(0), F.least(F.lit(1 << bits), F.round(x / F.sum("target").over(W.partitionBy()) * (1 << bits)).cast("long")))
    spans = sources.select("sid", share(cumulated - F.col("target")).alias("low"), share(cumulated).alias("high")).where("low < high")
    runs = spans.select("sid", "low", "high", F.explode(F.sequence(F.expr(f"low div {RUN}"), F.expr(f"(high - 1) div {RUN}"))).alias("run"))
    # a run is a few bytes but makes 65,536 rows, so the number of tasks is given and not left to the size of the input
    runs = runs.repartition(min(MOST_TASKS, max(1, (1 << bits) // RUN)), "sid", "run")
    first, last = F.greatest("low", F.col("run") * RUN), F.least("high", (F.col("run") + 1) * RUN) - 1
    points = runs.select("sid", F.explode(F.sequence(first, last)).alias("point"))
    taken = points.select("sid", reversed_bits(F.col("point"), bits).alias("slot")).where(F.col("slot") < slots).withColumn("part", F.expr(f"slot div {RUN}"))
    before = F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = taken.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n")).select("sid", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("sid", "part").orderBy("slot")) - 1
    return taken.withColumn("within", within).join(counts, ["sid", "part"]).select("sid", "slot", (F.col("before") + F.col("within")).alias("rank"))


def mixed_pieces(docs: DataFrame, cap: int = 3, block: int = BLOCK, seed: int = 42, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id long, text, source): pieces and documents.

    pieces: slot of the mix, source, doc_id, the document's place in its source's stream (``at``), ``start`` (its word
    at which the piece starts) and ``words``; the mix is the pieces by slot, at, start.  documents: doc_id, source, size,
    source_size, target, ``at`` and the columns ``keep``, one row for each row of ``docs``.
    """
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *keep))
    weight = (F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("weight", weight)
    sources = settle(targets(sources, cap).withColumn("sid", F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last()))))
    n_sources, rows, total = sources.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("source_size")).first()
    slots = settle(schedule(sources, -(-(total or 0) // block)))
    n_slots = slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n_slots"))
    table = sources.join(n_slots, "sid", "left").select("sid", "source", "source_size", "target", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))

    # the shuffled stream of each source: by a hash of the doc_id, in parts that are summed first
    bits = max(1, ((rows or 0) // 4096).bit_length())
    shuffled = F.xxhash64(F.lit(seed), "doc_id")
    known = sized.join(_small(table, n_sources), sized.source.eqNullSafe(table.source)).select("sid", "doc_id", table.source, "size", "source_size", "target", "n_slots", shuffled.alias("h"), *keep)
    parted = known.withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    before = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parted.groupBy("sid", "part").agg(F.sum("size").alias("n")).select("sid", "part", before.alias("before"))
    within = F.sum("size").over(W.partitionBy("sid", "part").orderBy("h", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = parted.withColumn("within", within).join(parts, ["sid", "part"]).withColumn("at", F.col("before") + F.col("within")).drop("h", "part", "before", "within")
    placed = settle(placed)

    turns = placed.where("size > 0").select("*", F.explode(F.array(*[F.lit(e) for e in range(cap)])).alias("turn")).withColumn("first", F.col("turn") * F.col("source_size") + F.col("at"))
    turns = turns.where(F.expr(f"first div {block} < n_slots"))
    blocks = turns.select("sid", "source", "doc_id", "at", "first", "size", F.explode(F.sequence(F.expr(f"first div {block}"), F.least(F.expr(f"(first + size - 1) div {block}"), F.col("n_slots") - 1))).alias("rank"))
    start = F.greatest(F.lit(0), F.col("rank") * block - F.col("first"))
    stop = F.least(F.col("size"), (F.col("rank") + 1) * block - F.col("first"))
    pieces = blocks.join(slots, ["sid", "rank"]).select("slot", "sid", "source", "doc_id", "at", start.alias("start"), (stop - start).alias("words"))
    return pieces, placed.drop("n_slots")


def mix(docs: DataFrame, cap: int = 3, block: int = BLOCK, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and source for each row of ``docs`` (doc_id long, text string, source string).

    size: words of the text.  Sources, by code point with null last, weigh 1, 2, 3, 1 and so on, and share the sum of all
    sizes; see ``targets``.  taken: words of the row that the mix takes, at most ``cap`` times its size.  A source's taken
    words are within a few blocks of its target.  A null or empty text has size 0 and is never taken; a null source is a
    source.  Repeated rows are taken one by one.  Reruns agree, as the order is by a hash of doc_id.  An empty table gives
    an empty result.  ``keep`` names further columns of ``docs`` to return; they break ties in the order.
    """
    pieces, placed = mixed_pieces(docs, cap, block, seed, keep)
    taken = pieces.groupBy("sid", "at").agg(F.sum("words").alias("taken"))
    some = placed.where("size > 0").join(taken, ["sid", "at"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *keep]
    return some.select(*columns).union(none.select(*columns))
