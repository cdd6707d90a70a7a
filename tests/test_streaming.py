import math

import numpy as np

from weftline.plans.program import run
from weftline.sdk import nodes as n
from weftline.streaming.stateful import Step, stateful


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    xs = [None if i % 7 == 3 else math.nan if i % 11 == 5 else float(rng.normal()) for i in range(120)]
    schema = "k int, t long, x double"
    data = [(i % 2, i, v) for i, v in enumerate(xs)]
    folder = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(data[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(folder))
    taps = (0.5, 0.3, 0.2)
    steps = [Step("input", "x", "a"), Step("delay", "a", "b", rows=3), Step("sub_delta", "a", "c"), Step("cum_sum", "a", "d"), Step("cum_sum_clamped", "a", "e"), Step("decaying_sum", "a", "f", rate=0.25), Step("slow_pass_zero", "a", "g"), Step("conv", "a", "h", kernel=taps), Step("fwd_fill_zero", "a", "i"), Step("scan_if", "a", "j", other=4.0, start=1.0)]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stateful(stream, steps, ["k"], ["t"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.k, r.t): r for r in spark.table("found").collect()}
    assert len(got) == len(data)

    x = n.source("x")
    kernel = n.Window("taps", n.i64(3), n.to_ts(n.arr([n.f64(t) for t in taps])))
    program = [n.emit("a", x), n.emit("b", n.delay(x, n.i64(3))), n.emit("c", n.sub_delta(x)), n.emit("d", n.cum_sum(x)), n.emit("e", n.cum_sum_clamped(x)), n.emit("f", n.decaying_sum(x, n.f64(0.25))), n.emit("g", n.slow_pass_zero(x)), n.emit("h", n.conv(kernel, x)), n.emit("i", n.fwd_fill_zero(x)), n.emit("j", n.scan_if(x, n.f64(4.0), n.f64(1.0)))]
    # files arrive in any order: number the rows as the stream did
    order = {(r.k, r.idx): r.t for r in got.values()}
    frame = spark.createDataFrame([(k, i, xs[t]) for (k, i), t in order.items()], "k int, idx long, x double")
    for r in run(frame, program, by=["k"]).orderBy("k", "idx").collect():
        s = got[r.k, order[r.k, r.idx]]
        for c in "abcdefghij":
            a, b = r[c], s[c]
            assert (a is None) == (b is None or not math.isfinite(b)), (c, r.idx, a, b)
            assert a is None or abs(a - b) < 1e-9, (c, r.idx, a, b)
