import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediaprism.llm import toxicity

INSULTS = "idiot moron scum trash loser".split()


def corpus(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 200))]
        bad = i % 8 == 0
        for _ in range(r.randrange(2, 7) * bad):
            words.insert(r.randrange(len(words)), r.choice(INSULTS) + r.choice(["", ".", ","]))
        rows.append((i, " ".join(words), "s" + str(i % 3)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(2000)
    docs, marks = make([*rows, (None, None), (5000, ""), (5001, None)]), spark.createDataFrame([*labels, (3, None), (None, 1), (1999, labels[1999][1])], "doc_id bigint, toxic int")
    out = toxicity.score_texts(docs, toxicity.train(docs, marks)).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == 2003
    truth = dict(labels)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.9 and sum(p for p, y in held if not y) <= 2
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and 1740 < kept.count() < 1800
    none = toxicity.score_texts(docs, toxicity.train(docs, marks.filter("toxic = 7")))
    assert none.filter("score <> 0.5").count() == 0 and toxicity.score_texts(make([]), toxicity.train(make([]), marks)).count() == 0


def test_no_label_of_a_held_out_row_counts(spark, make):
    rows, labels = corpus(300, 3)
    docs = make(rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    score = lambda m: sorted((r.doc_id, r.score) for r in toxicity.score_texts(docs, toxicity.train(docs, spark.createDataFrame(m, "doc_id bigint, toxic int"))).collect())
    assert score(labels) == score(flipped)


def test_stages_one_by_one(spark, make, tmp_path):
    """Each stage's effect on its own input, then the whole run over the same tables."""
    rows, labels = corpus(400, 5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"{' '.join(f'u{i}x{k}' for k in range(40))} {passage} {' '.join(f'v{i}y{k}' for k in range(40))}", "s1") for i in range(4)] + [(2000 + i, " ".join(f"c{k}" for k in range(80)), "s2") for i in range(5)] + [(3000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, str(tmp_path))
        path = str(tmp_path / name)
        at.write.parquet(path)
        at = spark.read.parquet(path)
        seen[name] = at
        assert name == "packing" or at.columns == before.columns
    toxic = {i for i, y in labels if y}
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert {1000, 1001, 1002, 1003, 2000, 3000} <= kept and len(toxic & kept) < 8 and len(kept - toxic) >= 355
    assert [r.doc_id for r in seen["near_dedup"].filter("doc_id BETWEEN 2000 AND 2004").collect()] == [2000]
    texts = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert all("p30" not in texts[1000 + i] and f"u{i}x3" in texts[1000 + i] for i in range(4)) and len(texts) == seen["near_dedup"].count()
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert set(words(seen["mixing"])) <= set(words(seen["substring_dedup"])) and seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    want = sorted(map(tuple, seen["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)
    assert want == sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)


def test_registry(spark):
    from mediaprism.llm import registry

    assert len(registry.QUERIES) == 10 and set(registry.ORACLE_SQL) <= set(registry.QUERIES) and corpus_pipeline.ORACLE_SQL is None
    for name in ("op1_html_extraction", "op3_mixing", "op6_toxicity", "op9_best_fit_packing"):
        table = "pages" if name.startswith("op1_") else "documents"
        n = len(pd.read_parquet(f"/root/testdata/sf0.001/{table}.parquet"))
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
        assert len(got) >= n if name == "op9_best_fit_packing" else len(got) == n


@pytest.mark.parametrize("missing", ["mediaprism.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(missing):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and len(e.queries()) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_entry_with_the_subpackage():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and sum(k.startswith("op") for k in __spark_entry__.queries()) == 10
