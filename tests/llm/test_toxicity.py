import zlib

import numpy as np

from leafledger.llm import toxicity
from leafledger.llm.queries import op2_toxicity

from . import docs


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = op2_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in kept]) > 0.85
    assert op2_toxicity(spark, path).count() == spark.read.parquet(f"{path}/documents.parquet").count()


def labelled(spark, path, texts, labels):
    return docs.write(spark, path, texts, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_planted_words(spark, tmp_path):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    texts = [" ".join(word() for _ in range(60)) + (" zzgrim zzgrot" * 2 if i % 4 == 0 else "") for i in range(240)] + docs.TEXTS
    path = labelled(spark, tmp_path, texts, [(i, 1, int(i % 4 == 0)) for i in range(240)] + [(3, None, None), (None, 1, 1), (10_000, 1, 1)])
    got = {r.doc_id: r for r in op2_toxicity(spark, path).collect()}
    assert len(got) == len(texts)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(240) if got[i].held_out]) == 1
    assert got[243].score < 0.5 and got[244].score == got[243].score


def test_no_labels_and_no_documents(spark, tmp_path):
    path = labelled(spark, tmp_path / "a", docs.TEXTS, [(1, 1, 0)])
    assert {r.score for r in op2_toxicity(spark, path).collect()} == {0.0}
    assert op2_toxicity(spark, labelled(spark, tmp_path / "b", [], [(1, 1, 0)])).count() == 0
