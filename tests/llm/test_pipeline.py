"""Each stage of the pipeline on its own input, against plain versions."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, brute_classes, brute_lines

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, inputs = docs.columns, {}
    for name, stage in c.STAGES:
        inputs[name] = docs
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != c.STAGES[-1][0]:
            assert docs.columns == names
    rows = {k: [(r.doc_id, r.text) for r in v.select("doc_id", "text").collect()] for k, v in inputs.items()}

    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows["line_dedup"]}
    clean = [i for i, _ in rows["quality"] if labels.get(i) == (1, 0)]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    bad = [i for i, _ in rows["quality"] if i in labels and labels[i][0] == 0]
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)

    assert sorted(rows["near_dedup"], key=str) == [(i, t) for i, t, _, _ in brute_lines(rows["line_dedup"])]

    words = [(i, t) for i, t in rows["near_dedup"] if WORD.search(t or "")]
    classes = defaultdict(list)
    for i, k in brute_classes(words):
        classes[k].append(i)
    assert sorted(i for i, t in rows["mixing"] if WORD.search(t or "")) == sorted(classes)

    size = {i: len(WORD.findall(t or "")) for i, t in rows["mixing"]}
    taken = Counter()
    for i, t in rows["packing"]:
        taken[i] += len(WORD.findall(t))
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 0.03 * sum(size.values()) + 32 * 20

    out = docs.agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s"), F.max("sequence_id").alias("m")).first()
    assert out.s == out.m + 1 == -(-out.n // 1024)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n <> e or n > 1024").count() == 0


def _as_stages(spark, docs, folder) -> list:
    """What each stage makes of ``docs``, written and read again in between."""
    import corpus_pipeline as c

    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    made = []
    for name, stage in c.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        made.append(docs)
    return made


CLASHING = "_id string, _hash string, _size string, _taken string, _doc string, keep string, votes string, n_lines string, class_id string"


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    words = "river stone quiet morning harbour lantern meadow winter copper garden".split()
    text = lambda k: " ".join(words[(k * j + j) % 10] + str(k * j % 17) for j in range(1, 40)).capitalize() + "."
    shared = "A line of some length that two documents share."
    rows = [(i, text(i), "web") for i in range(1, 30)]
    rows += [(40, text(40) + "\n" + shared, "web"), (41, shared + "\n" + text(41), None), (42, text(42), None), (43, text(42), "web")]
    rows += [(50, None, "web"), (51, "", None), (None, None, "web"), (None, text(60), "books"), (5, text(5), "web"), (61, text(61) * 3000, "books")]
    extra = CLASHING.count("string")
    docs = spark.createDataFrame([(i, t, s, 0, *[f"x{i}"] * extra) for i, t, s in rows], f"doc_id long, text string, source string, n_chars long, {CLASHING}")
    made = _as_stages(spark, docs, f"file://{tmp_path}/sf")
    for out in made[:-1]:
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert all(set(r[4:]) == {f"x{r.doc_id}"} for r in out.collect())
    good, lines, near, mixed, packed = (x.collect() for x in made)
    assert sorted((r.doc_id, r.text) for r in good if r.doc_id and r.text) == sorted((i, t) for i, t, _ in rows if i and t)
    assert len(good) == len(lines) == len(rows)
    assert {r.doc_id: r.text for r in lines if r.doc_id in (40, 41)} == {40: text(40) + "\n" + shared, 41: text(41)}
    ids = [r.doc_id for r in near if (r.text or "").strip()]
    assert sorted(i for i in ids if i) == [*range(1, 30), 40, 41, 42, 61] and ids.count(None) == 1
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[r.doc_id] <= 3 * len(WORD.findall(r.text or "")) for r in near if r.doc_id)
    assert sum(r.length for r in packed) >= sum(taken.values())


def test_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    made = _as_stages(spark, docs, f"file://{tmp_path}/sf")
    assert all(x.count() == 0 for x in made) and all(x.columns == docs.columns for x in made[:-1])
