"""SimHash document fingerprints and their Hamming neighbours, with DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import settle

SPACES = r"[\x20\x09-\x0D]+"
#: The largest weight of a term, and terms that are counted together: their product is below 2 ** 15, so that sums stay positive longs.
MOST_WEIGHT, TOGETHER = 15, 2048


def terms(text: Column) -> Column:
    """(h, w): hash and weight of each pair of neighbouring words; of the word, if there is only one."""
    words = F.array_remove(F.split(text, SPACES), "")
    weight = lambda n: F.least(F.lit(MOST_WEIGHT), n).cast("long")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), weight(F.length(a) + F.length(b)).alias("w")))
    return F.when(n > 1, pairs).otherwise(F.transform(words, lambda a: F.struct(F.xxhash64(a).alias("h"), weight(F.length(a)).alias("w"))))


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (long) for each distinct value of ``keys``, which must name one row each.

    Each term's hash votes on 64 signed bits with its weight.  Sixteen sums hold four 16-bit counters each, over at most
    2,048 terms, so a row costs 16 sums and not 64; the counters are then added as longs.  No text gives fingerprint 0.
    """
    each = rows.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("pos", "term"))
    lane = 0x0001000100010001
    counted = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lane)) * F.col("w")).alias(f"l{j}") for j in range(16)]
    each = each.select(*keys, F.expr(f"pos div {TOGETHER}").alias("part"), F.coalesce("term.h", F.lit(0)).alias("h"), F.coalesce("term.w", F.lit(0)).alias("w"))
    parts = each.groupBy(*keys, "part").agg(*counted, F.sum("w").alias("weight"))
    votes = [F.sum(2 * F.shiftrightunsigned(f"l{b % 16}", 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF)) - F.col("weight")).alias(f"v{b}") for b in range(64)]
    bits = [F.when(F.col(f"v{b}") > 0, F.lit((1 << b) - ((1 << 64) if b == 63 else 0))).otherwise(F.lit(0)) for b in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return parts.groupBy(*keys).agg(*votes).select(*keys, fp.cast("long").alias("fp"))


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def following(rows: DataFrame) -> DataFrame:
    """(row, next_row, quarter) for each of ``rows`` (row, doc_id, th, n_chars): the row after it, and floor(n_chars / 4).

    The order is by doc_id (null first), then th, then row; the first follows the last.  ``row`` is unique, so the range
    partitions are even however often a doc_id occurs and however far ids lie apart; no arithmetic is done on ids.
    """
    by = [F.col("doc_id").asc_nulls_first(), "th", "row"]
    ordered = rows.select("row", "doc_id", "th", F.expr("cast(n_chars div 4 as int)").alias("quarter")).repartitionByRange(*by).sortWithinPartitions(*by)
    # ids in a written partition are consecutive, and those of a later one are higher
    placed = settle(ordered.select("row", "quarter", F.monotonically_increasing_id().alias("place")))
    edges = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    whole = W.partitionBy()  # one row for each range partition
    ahead = edges.select("last", F.coalesce(F.lead("first").over(whole.orderBy("part")), F.min("first").over(whole)).alias("ahead"))
    known = placed.join(F.broadcast(ahead), placed["place"] == ahead["last"], "left").select("row", "quarter", F.coalesce("ahead", F.col("place") + 1).alias("place"))
    return known.join(placed.select(F.col("row").alias("next_row"), "place").hint("merge"), "place").select("row", "next_row", "quarter")


def fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """The fingerprints of each row of ``docs`` (doc_id long, text string; other columns are ignored) and of its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, by ascending doc_id, rows of one doc_id by a hash of their text, null first; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited, near_next,
    next_id (the next document's doc_id) and n_near: for doc_ids that ``every`` divides, the other rows whose fingerprints
    are within ``radius`` bits, found in the permuted block tables of all rows; else null.

    A null text is empty; an empty text has fingerprint 0.  Equal texts have equal fingerprints.  Repeated rows give a row
    each.  A very long text is counted in parts of its terms.  A table of one row is its own successor; an empty table gives
    an empty result.  Texts are shuffled once, by a unique row key, and the heads of texts once more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("th"), F.length("text").alias("n_chars")))
    # ids compress so well that a file of them looks small enough to broadcast, which in memory it isn't
    follow = settle(following(rows)).hint("merge")
    texts = rows.select("row", "doc_id", "text")  # the same columns in both joins, so that their shuffle is the same one
    heads = texts.join(follow.select(F.col("next_row").alias("row"), F.col("row").alias("to"), "quarter"), "row").select("to", F.col("doc_id").alias("next_id"), "quarter", F.substr("text", F.lit(1), F.col("quarter")).alias("head"))
    both = texts.join(heads, texts["row"] == heads["to"])
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("quarter")), F.col("head"))
    both = both.select("row", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["row", "doc_id", "next_id", "n_chars", "edited_sha256"]
    variants = both.select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    found = simhash(variants, [*keys, "which"]).groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    found = settle(found)
    following_fp = follow.join(found.select(F.col("row").alias("next_row"), F.col("fp").alias("next_fp")), "next_row").select("row", "next_fp")
    asked = F.col("doc_id") % every == 0
    near = near_counts(found.where(asked).select("fp"), found.select("fp"), radius)
    counts = found.where(asked).select("row", "fp").join(near, "fp").select("row", (F.col("n") - 1).alias("n_near"))
    found = found.join(following_fp, "row").join(counts, "row", "left")
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("fp")).alias("fingerprint"), fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "next_id", "n_near")


def _near(asked: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance, n): each a of ``asked`` (fp) with each b of ``known`` (fp, n) within ``radius`` bits, itself included.

    Permuted block tables: 64 bits are cut into 2 * radius blocks; two fingerprints within the radius agree in at least
    radius blocks, so they meet in the table of those.  A pair counts in the first table in which it meets.
    """
    if not 0 <= radius <= 8:
        raise ValueError("the radius is 0 to 8 bits")
    blocks = max(1, 2 * radius)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("table", "mask")
    keyed = lambda rows, *names: rows.select("fp", *names, tables).select("fp", *names, "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    x, y = keyed(asked).alias("x"), keyed(known, "n").alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    met = x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.key") == F.col("y.key")) & (F.bit_count(apart) <= radius))
    first = F.array_position(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: apart.bitwiseAND(m) == 0), True) - 1
    return met.where(F.col("x.table") == first).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.bit_count(apart).alias("distance"), F.col("y.n").alias("n"))


def near_counts(asked: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, n): how many rows of ``prints`` (fp long) are within ``radius`` bits of each distinct fp of ``asked``.

    Equal fingerprints are counted before the tables are made, so a fingerprint that many rows share is one row in them.
    Nulls are left out; an empty table gives an empty result.  0 <= radius <= 8.
    """
    known = prints.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return _near(asked.where("fp is not null").select("fp").distinct(), known, radius).groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n"))


def neighbours(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance): all pairs a < b of distinct fingerprints ``fp`` (long) of ``prints`` within ``radius`` bits.

    Documents of equal fingerprints are one; join them back by ``fp``.  Nulls are left out; an empty table gives an empty
    result.  0 <= radius <= 8.
    """
    each = prints.where("fp is not null").select("fp").distinct()
    return _near(each, each.withColumn("n", F.lit(1)), radius).where("a < b").select("a", "b", "distance")
