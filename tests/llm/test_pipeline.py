from collections import Counter

import corpus_pipeline
from conftest import EXTRA, texts
from test_operators import ids_of, linked

from weftline.llm import secrets, toxicity
from weftline.llm.common import settle
from weftline.llm.mixing import mix


def test_stages(spark, tmp_path):
    corpus = {i: t for i, t in texts(5).items()}
    corpus[200] = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + "plain words that stand here " * 3
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus.items()], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in corpus], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    folder, made = str(tmp_path), [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        made.append(settle(stage(spark, made[-1], folder)))
    rows = [{r.doc_id: r.text for r in x.collect()} for x in made[:-1]]
    assert all(x.columns == docs.columns for x in made[:-1])

    model = toxicity.train_on(made[0], spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert set(rows[1]) == {r.doc_id for r in toxicity.score(made[0], model).collect() if not r.predicted}
    _, component = linked(rows[1], 5)
    assert set(rows[2]) == {i for i, c in component.items() if i == c}
    assert set(rows[3]) == set(rows[2]) and rows[3].get(200, "[secret]").count("[secret]") == 1
    assert all(rows[3][i] == t for i, t in rows[2].items() if i != 200)
    assert secrets.KINDS[0] == "assign" and set(rows[4]) <= set(rows[3])
    copies = Counter(r.doc_id for r in made[4].collect())
    assert max(copies.values()) <= 3
    want = Counter({i: copies[i] * len(x) for i, x in ids_of({i: rows[4][i] for i in copies}).items()})
    got = Counter()
    for r in made[5].collect():
        got[r.doc_id] += r.length
    assert got == want and corpus_pipeline.run(spark, folder).count() == len(made[5].collect()) and EXTRA


def test_near_dedup_keeps_one_row_of_a_group(spark, repeated):
    got = corpus_pipeline.near_dedup(spark, repeated, "")
    assert got.columns == repeated.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in got.collect()) == [(0, True), (1, False), (2, False)]
    corpus = texts(5)
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(7, corpus[0]), (3, corpus[0]), (None, corpus[0]), (7, other), (None, corpus[1]), (None, corpus[1]), (None, None), (8, None), (3, corpus[0])]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(3, corpus[0]), (7, other), (None, corpus[1]), (None, None), (8, None)])


def test_mix_takes_rows_one_by_one(spark):
    words = "some ten words that each of these rows has alike"
    rows = [(None, f"{words} {i}", f"s{i % 3}", i) for i in range(300)] + [(5, f"{words} {i}", "s0", i) for i in range(300, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3).cache()
    got = Counter((r.source, r.text) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    want = mix(docs, cap=3).collect()
    for source in ("s0", "s1", "s2"):
        assert Counter(n for (s, _), n in got.items() if s == source) == Counter(-(-r.taken // r.size) for r in want if r.source == source and r.taken)
