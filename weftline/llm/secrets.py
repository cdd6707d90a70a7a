"""Secret scans, with DataFrame functions only: patterns of known forms, and character Markov models of random strings
and of ordinary identifiers that are compared by log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import unused

# The forms to find, in the order in which kinds are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIDE = len(ALPHABET) + 1
#: A candidate is a secret if its ratio is this much for each transition, and this much in all.
MEAN_RATIO, TOTAL_RATIO = 0.4, 12.0
#: So much under its peak a random stretch of a longer run is over.  The signs between words of a run; least characters.
DROP_RATIO, SIGNS, LEAST = 12.0, "/_-", 20

# Words of ordinary identifiers and paths.
NOUNS = "account address application array balance block buffer button cache channel client cluster column config connection container content context controller counter customer database default description device directory document element endpoint error event example factory field file filter folder format function handler header history image index information input instance interface invoice item iterator language layout length library line listener location manager memory message method model module monitor name network node number object operator option order output package page parameter partition password path payload payment person pipeline pointer position process product profile project property provider query queue record reference registry report request resource response result router schedule schema scope script section server service session setting signature size source state statement status storage stream string structure system table target template thread time timestamp token total tracker transaction transform type update user utility validator value variable vector version view widget window worker".split()
VERBS = "accept add apply build calculate cancel check clear close commit compare compute connect convert copy count create decode delete download enable encode execute export fetch find flush generate get handle import initialize insert join list load lock make merge move normalize open parse print process publish read register release remove render replace reset resolve restore return save scan search select send set show sort split start stop store submit subscribe sync test translate update upload validate wait write".split()
PROSE = "and that with this from have they which would there their what about when your said could into than them some other these time then only very should where after through before great between another because against always during without again place around however small found those never under might while house world still below asked going large until along shall being often together important government something development international und der die das nicht eine einen werden haben durch wenn gegen zwischen gesellschaft entwicklung le les des dans pour avec est une sont mais comme plus tout nous cette entre gouvernement el los las una para con por como pero sus este entre cuando desarrollo".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, random): ``n`` random strings (base 64, base 62, hex) and ``n`` ordinary identifiers, both made by rule."""
    words = lambda x: F.array(*[F.lit(w) for w in x])
    pick = lambda x, salt: F.element_at(words(x), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(x))) + 1).cast("int"))
    digest = F.concat(F.sha2(F.col("id").cast("string"), 256))
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.regexp_replace(base64, "[+/]", "")).when(F.col("id") % 4 == 2, F.translate(base64, "+/", "-_")).otherwise(base64)
    cap = F.initcap
    v, a, b, c = pick(VERBS, "v"), pick(NOUNS, "a"), pick(NOUNS, "b"), pick(PROSE, "c")
    forms = [F.concat(v, cap(a), cap(b)), F.concat_ws("_", v, a, b), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, v), F.upper(F.concat_ws("_", a, b)), F.concat(c, pick(PROSE, "d"), pick(PROSE, "e")), F.concat(a, b, pick(PROSE, "f")), F.concat(cap(a), cap(b), (F.col("id") % 100).cast("string"))]
    ordinary = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    ids = spark.range(n, numPartitions=1)
    return ids.select(random.alias("text"), F.lit(1).alias("random")).union(ids.select(ordinary.alias("text"), F.lit(0).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio, random to ordinary, of each transition between two characters (row by row).

    ``samples`` has text and random (0 or 1); nulls and texts under two characters teach nothing.  Its counts are summed
    on Spark; at most 2 * 67 * 67 of them come to the driver.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i")
    pairs = samples.where("length(text) > 1").select("text", "random", at)
    x, y = (F.instr(F.lit(ALPHABET), F.substr("text", F.col("i") + k, F.lit(1))) for k in (0, 1))
    counts = pairs.select("random", x.alias("x"), y.alias("y")).groupBy("random", "x", "y").count().collect()
    table = [[[1.0] * SIDE for _ in range(SIDE)] for _ in range(2)]
    for label, a, b, n in counts:
        table[label][a][b] += n
    logs = [[[math.log(v / sum(row)) for v in row] for row in side] for side in table]
    return [r - o for x, y in zip(logs[1], logs[0], strict=True) for r, o in zip(x, y, strict=True)]


def _found(text: Column, pattern: str) -> Column:
    """(s, e, t): start, end (code points, exclusive) and text of the leftmost non-overlapping matches."""
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,t:string>>)")
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), b.alias("t")))
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(empty)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def _stretches(x: Column, base: Column) -> Column:
    """(s, e) of the random stretches of a run ``x`` (s, e, t, and r: the ratio of each transition).

    A stretch goes from where the running ratio, less ``MEAN_RATIO`` a transition, leaves zero to its peak; it is over once
    the ratio is back at zero or ``DROP_RATIO`` under the peak, and then the next one can start.  It counts if its ratio is
    ``TOTAL_RATIO`` in all and, cut or widened to whole words, it is ``LEAST`` characters long.  Words end at ``SIGNS`` and at
    spans in ``base``; of a word at either end, the stretch gets all if it has half, and else nothing.
    """
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
    state = lambda i, at, total, best, last, out: F.struct(i.alias("i"), at.alias("at"), total.alias("total"), best.alias("best"), last.alias("last"), out.alias("out"))
    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)

    def closed(acc: Column) -> Column:
        telling = acc["best"] + MEAN_RATIO * (acc["last"] - acc["at"]) >= TOTAL_RATIO
        return F.when(telling, F.array_append(acc["out"], F.struct(acc["at"].alias("s"), (acc["last"] + 1).alias("e")))).otherwise(acc["out"])

    def step(acc: Column, r: Column) -> Column:
        after, total = acc["i"] + 1, acc["total"] + r - MEAN_RATIO
        over = (total <= 0) | (total < acc["best"] - DROP_RATIO)
        higher = state(after, acc["at"], total, total, after, acc["out"])
        lower = state(after, acc["at"], total, acc["best"], acc["last"], acc["out"])
        return F.when(over, state(after, after, nothing, nothing, after, closed(acc))).otherwise(F.when(total > acc["best"], higher).otherwise(lower))

    def widened(y: Column) -> Column:
        before = F.length(F.regexp_extract(F.substr(x["t"], F.lit(1), y["s"].cast("int")), f"[^{SIGNS}]*$", 0))
        behind = F.length(F.regexp_extract(F.substr(x["t"], (y["e"] + 1).cast("int"), F.length(x["t"])), f"^[^{SIGNS}]*", 0))
        core = F.substr(x["t"], (y["s"] + 1).cast("int"), (y["e"] - y["s"]).cast("int"))
        lead, tail = F.length(F.regexp_extract(core, f"^[^{SIGNS}]*", 0)), F.length(F.regexp_extract(core, f"[^{SIGNS}]*$", 0))
        s, e = x["s"] + y["s"], x["s"] + y["e"]
        start = F.when((lead < before) & (lead < F.length(core)), s + lead + 1).otherwise(s - before)
        stop = F.when((tail < behind) & (tail < F.length(core)), e - tail - 1).otherwise(e + behind)
        low = F.array_max(F.transform(F.filter(base, lambda b: b["e"] <= s), lambda b: b["e"]))
        high = F.array_min(F.transform(F.filter(base, lambda b: b["s"] >= e), lambda b: b["s"]))
        return F.struct(F.greatest(start, low).alias("s"), F.least(stop, high).alias("e"))

    found = F.aggregate(x["r"], state(zero, zero, nothing, nothing, zero, none), step, closed)
    wide = F.filter(F.transform(found, widened), lambda y: y["e"] - y["s"] >= LEAST)
    # two stretches between the same signs are one span
    return F.aggregate(wide, none, lambda out, y: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["e"] > y["s"]), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(F.try_element_at(out, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(out, F.lit(-1))["e"], y["e"]).alias("e")))).otherwise(F.array_append(out, y)))


def _spans(docs: DataFrame, ratios: list[float], out: str) -> DataFrame:
    """``docs`` with a column ``out``: an array of (s, k, e) for each text; a null text has none."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    each = {kind: unused(docs.columns, f"_{kind}") for kind in KINDS}
    assign = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 8)
    rows = docs.withColumns(dict(zip(each.values(), (assign, _found(text, ACCESS), _found(text, HEX), _found(text, CANDIDATE)), strict=True)))
    base, markov = F.concat(*[each[kind] for kind in KINDS[:3]]), each["markov"]

    def rated(x: Column) -> Column:
        """The ratio of each transition of a run; those at the characters of a span in ``base`` are hopeless."""
        codes = F.transform(F.split(x["t"], ""), lambda c: F.instr(F.lit(ALPHABET), c))
        n = F.length(x["t"]) - 1
        ratio = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(table, a * SIDE + b + 1))
        apart = F.transform(ratio, lambda r, i: F.when(F.exists(base, lambda b: (b["s"] <= x["s"] + i + 1) & (x["s"] + i < b["e"])), F.lit(-1e9)).otherwise(r))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.when(F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])), apart).otherwise(ratio).alias("r"))

    def random(x: Column) -> Column:
        """Spans of a run: all of it if it is random on the whole, or else its random stretches."""
        total = F.aggregate(x["r"], F.lit(0.0), lambda acc, r: acc + r)
        whole = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.when(total >= F.greatest(F.lit(TOTAL_RATIO), MEAN_RATIO * (F.length(x["t"]) - 1)), whole).otherwise(_stretches(x, base))

    rows = rows.withColumn(markov, F.transform(markov, rated))
    rows = rows.withColumn(markov, F.flatten(F.transform(markov, random)))
    tagged = [_tagged(F.col(each[kind]), k) for k, kind in enumerate(KINDS)]
    return rows.withColumn(out, F.array_sort(F.concat(*tagged))).drop(*each.values())


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """The secrets of each row of ``docs`` (doc_id long, text string; other columns are ignored); ``ratios`` from ``train``.

    Returns doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 (of the spans of the first three kinds) and spans
    (kind:start:end, comma-joined, by start, then kind; code points, end exclusive).  assign, access and hex are the fixed
    forms; markov are other strings of 20 or more characters of the base-64 alphabets that the models hold for random and
    that overlap none of the former: whole runs of such characters, or stretches of them, as a key at the end of a path.  A null text is empty and has no span.  Rows are scanned one by one, whatever their
    length; an empty table gives an empty result.  Nothing is shuffled.
    """
    rows = _spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios, "_found")
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    sizes = [_number(F.col("_found"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = written(F.filter("_found", lambda x: x["k"] < 3))
    return rows.select("doc_id", *sizes, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("_found")).alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mask: str = "[secret]") -> DataFrame:
    """``docs`` with each span that ``scan`` finds replaced by ``mask``; overlapping spans are one.  Columns stay as they
    are; a null text stays null."""
    found = unused(docs.columns, "_found")
    rows = _spans(docs, ratios, found)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["s"] < acc["at"], F.lit("")).otherwise(F.concat(F.substr("text", (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    clean = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    return rows.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text"))).drop(found)
