import math

import pytest
from golden import cases

from weftline.plans.program import run
from weftline.sdk import nodes as n

CASES = cases()


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    columns, node, want = CASES[name]
    data = [(i, *(float(v[i]) for v in columns.values())) for i in range(len(want))]
    df = spark.createDataFrame(data, "idx long, " + ", ".join(f"{k} double" for k in columns))
    got = [r.z for r in run(df, [n.emit("z", node)]).orderBy("idx").collect()]
    assert len(got) == len(want)
    for i, (a, b) in enumerate(zip(got, want, strict=True)):
        assert (a is None) == math.isnan(b), (i, a, b)
        assert a is None or abs(a - b) < 1e-9, (i, a, b)
