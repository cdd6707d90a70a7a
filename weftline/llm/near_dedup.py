"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. Each text becomes the set of its word shingles (64-bit hashes); the k smallest are its sketch.  Equal sets are one class.
2. Inverted lists: a value that several classes retain links them.  Two sets with a similarity of 0.8 share most of their
   sketch, so they also share one of the rarest values of each (prefix filtering); only those lists are joined, which
   leaves passages that many documents share out of the joins.
3. Each list is first linked to its most central class, the one whose values are the most frequent: of near copies, the
   text that they were made from.  Then only classes that are not yet in one component are compared: in short lists pair
   by pair, in long ones by blocks of classes, each pair of blocks in a task that returns no more links than it has
   classes.  So a large group of near copies makes rows in proportion to its size, and no link is lost.
4. The sketch of the union estimates each pair; pairs that can't reach the similarity are dropped, the rest are
   confirmed on the full sets, made again from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, in_batches, pieces, settle, text_buffer
from weftline.llm.words import U, Words, lowered, mixed, signed, windows

#: Values that a sketch retains.
SKETCH = 64
#: With a similarity of 0.8 at least this many of 64 are shared, but for a chance of 6e-8.
SHARED = 33
#: Classes of a list up to which it is compared pair by pair, and of a block where it is longer.
SHORT, BLOCK = 64, 256
#: Pairs of one class that are confirmed together.
TOGETHER = 512


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than ``size``, one shingle of all."""
    words = Words(lowered(raw), off)
    hashes, counts = words.hashes(), np.diff(words.first)
    at = words.alone(size)
    whole, of = windows(hashes, at, size), words.doc[at]
    cuts = np.searchsorted(of, np.arange(len(off)))
    few = np.flatnonzero((counts > 0) & (counts < size))
    short = dict(zip(few.tolist(), windows(hashes, words.first[few], words.first[few + 1]), strict=True))
    return [np.array([short[i]], U) if i in short else np.unique(whole[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _node(s: np.ndarray) -> bytes | None:
    """The key of a class: 128 bits of its set; null for an empty set."""
    return np.array([mixed(s).sum(dtype=U), mixed(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)]).tobytes() if len(s) else None


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(*text_buffer(batch.column("text")), size)
            keys = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([signed(s[:SKETCH]) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "sketch"],
            )

    return run


def _confirm(size: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order: a text of the class a (b is null), then those of the classes b to compare with it."""
        at, whole = None, np.zeros(0, U)
        for batch in pieces(batches):
            found: list[tuple[bytes, bytes]] = []
            for a, b, own in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(*text_buffer(batch.column("text")), size), strict=True):
                if b is None:
                    at, whole = a, own
                    continue
                if a != at:
                    raise ValueError("the text to compare with is missing")
                both = len(np.intersect1d(whole, own, assume_unique=True))
                if 100 * both >= similarity * (len(whole) + len(own) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    full = F.array_union("sa", "sb")
    union = F.slice(F.array_sort(full), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    likely = F.when(F.size(full) < SKETCH, 100 * shared >= similarity * F.size(full)).otherwise(shared >= SHARED * similarity / 80 * F.size(union) / SKETCH)
    kept = settle(pairs.join(side("a"), "a").join(side("b"), "b").where(likely).select("a", "b"))
    # the text of a comes once for each TOGETHER of its pairs, which are a group of their own
    shares = kept.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("shares"))
    dealt = kept.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    text = lambda x: texts.select(F.col("node").alias(x), "text")
    others = dealt.join(text("b"), "b").select("a", "share", "b", "text")
    own = dealt.select("a", "share").distinct().join(text("a"), "a").select("a", "share", F.lit(None).cast("binary").alias("b"), "text")
    rows = others.union(own).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return in_batches(rows, _confirm(size, similarity), "a binary, b binary")


def _compare(size: int, similarity: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between classes of different labels, at most one for each that joins two labels."""
        nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
        blocks = table.column("block").to_numpy()
        sets = []
        for batch in pieces(iter(table.combine_chunks().to_batches())):
            sets += shingle_sets(*text_buffer(batch.column("text")), size)
        n = np.array([len(s) for s in sets], np.int64)
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(code, minlength=len(distinct)) > 1
        code, of = (np.cumsum(often) - 1)[code[often[code]]], of[often[code]]
        order = np.argsort(code, kind="stable")
        code, of, both = code[order], of[order], np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(code, [low, low + 4096])
            holds = np.zeros((len(sets), 4096), np.float32)
            holds[of[a:b], code[a:b] - low] = 1
            both += holds @ holds.T
        linked = (100 * both >= similarity * (n[:, None] + n[None, :] - both)) & (blocks[:, None] != blocks[None, :])
        parent = {x: x for x in labels}

        def root(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i, j in np.argwhere(np.triu(linked, 1)).tolist():
            p, q = root(labels[i]), root(labels[j])
            if p != q:
                parent[p] = q
                out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return run


def _links_in_blocks(lists: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Links between the members of the long ``lists`` (v, node, pivot, label) whose labels differ, enough to join them.

    Lists that share members are one cluster.  All its classes are dealt to blocks, and those outside its largest component
    to blocks of their own; each block of the first kind is compared with each of the second in one task, on the full sets.
    So n classes of which m are outside make about 2 * n * m / ``BLOCK`` rows."""
    mixed_lists = lists.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("v")
    open_lists = settle(lists.join(mixed_lists, "v").select("node", "pivot", "label").distinct())
    clusters = components(open_lists.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    members = clusters.select("node", F.col("label").alias("cluster")).join(open_lists.select("node", "label").distinct(), "node")
    # pairs within the largest component of a cluster need no link: only the others are compared with all
    counted = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = members.join(sizes.select("cluster", "main", blocks("all").alias("all"), blocks("outside").alias("outside")), "cluster").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod("h", F.col(n)).cast("int")
    whole = dealt.where("outside > 0").select("cluster", block("all").alias("i"), every("outside").alias("j"), F.lit(0).alias("block"), "node", "label")
    outside = dealt.where("label <> main").select("cluster", every("all").alias("i"), block("outside").alias("j"), F.lit(1).alias("block"), "node", "label")
    return whole.union(outside).join(texts, "node").groupBy("cluster", "i", "j").applyInArrow(_compare(size, similarity), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id long, text string; other columns are ignored).

    Documents are linked if 100 * intersection >= ``similarity`` * union of their sets of ``size``-word shingles (A-Z in
    lower case).  component_id is the smallest doc_id that can be reached, kept says whether the row has it.  A null or
    empty text, or one of white space, has no shingles and is linked with nothing.  Repeated rows and equal sets are one
    class.  A null doc_id is never the smallest unless the group has no other.  An empty table gives an empty result.
    ``similarity`` must be 80 or more: the sketch is sized for that.
    """
    if similarity < 80:
        raise ValueError("sketches are sized for a similarity of 80 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_docs = settle(in_batches(docs, _sketch(size), "doc_id long, n_shingles long, node binary, sketch array<long>"))
    sets = settle(signed_docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))

    # how many of the rarest values suffice: all but what any partner must share, and one
    m = F.size("sketch")
    must = F.when(F.col("n") <= int(SKETCH * 0.8), F.ceil(F.col("n") * similarity / 100)).otherwise(SHARED)
    values = sets.select("node", "n", (m - must + 1).alias("prefix"), m.alias("m"), F.explode("sketch").alias("v"))
    common = sets.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = values.join(common, "v").groupBy("node", "n", "prefix", "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"), (F.sum("df") / F.col("m")).alias("hub"))
    single = F.col("m") - F.size("s")
    lists = settle(lists.where(F.col("prefix") > single).select("node", "n", "hub", F.explode(F.slice("s", F.lit(1), F.col("prefix") - single)).alias("x")).select("node", "n", "hub", "x.v"))
    pivots = lists.groupBy("v").agg(F.max(F.struct("hub", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = settle(lists.join(pivots, "v"))

    listed = lists.select("node").distinct().join(sets.select("node", "rep"), "node")
    named_reps = listed.select("rep").distinct()
    texts = settle(_own_text(docs.join(named_reps, docs.doc_id.eqNullSafe(named_reps.rep), "left_semi"), listed, size))
    star = lists.where("node <> pivot").groupBy("pivot", "node").agg(F.first("n").alias("n")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = settle(_links(star, sets, texts, size, similarity))
    labels = components(links)
    named = settle(lists.join(labels, "node", "left").select("v", "node", "n", "pivot", "members", F.coalesce("label", "node").alias("label")))
    x, y = named.where(F.col("members") <= SHORT).alias("x"), named.where(F.col("members") <= SHORT).alias("y")
    apart = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.node") != F.col("x.pivot")) & (F.col("y.node") != F.col("x.pivot")) & (100 * F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")))
    rest = _links(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), sets, texts, size, similarity)
    rest = settle(rest.union(_links_in_blocks(named.where(F.col("members") > SHORT), texts, size, similarity)))

    groups = components(links.union(rest))
    named = sets.select("node", "rep").join(groups, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    of = named.join(smallest, "label").select("node", "least")
    out = signed_docs.select("doc_id", "n_shingles", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _own_text(docs: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """One text for each node of ``listed``, by the set of the text: a doc_id may have other texts, and many rows none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(*text_buffer(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), batch.column("text")], ["node", "text"])

    found = in_batches(docs.select("text"), run, "node binary, text string")
    return found.join(listed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
