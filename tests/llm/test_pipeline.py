import corpus_pipeline
from leafledger.llm import secrets
from leafledger.llm.store import saved, shared_dir

from . import docs
from .test_decontam import ITEM, bench
from .test_tokens_packing import ids_of


def stages(spark, path):
    folder, rows = shared_dir(spark), spark.read.parquet(f"{path}/documents.parquet")
    out = [rows]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], path), f"{folder}/{name}"))
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_stages_and_run(spark, tmp_path):
    path = docs.write(spark, tmp_path, docs.TEXTS + [ITEM, "password = hunter22hunter and so on"], benchmark=bench(spark, [(1, ITEM, 1)]), labels=labels(spark, []))
    raw, toxic, near, clean, masked, packed = stages(spark, path)
    for d in (toxic, near, clean, masked):
        assert d.columns == raw.columns
    n = len(docs.TEXTS)
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(toxic) == ids(raw)
    assert ids(raw) - ids(near) >= {1} and 0 in ids(near) and {3, 4, 5} <= ids(near)
    assert ids(near) - ids(clean) == {n}
    assert ids(masked) == ids(clean)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[n + 1] == "[SECRET] and so on" and texts[3] is None
    assert sum(r.length for r in packed.collect()) == sum(len(ids_of(t)) for t in texts.values())
    assert corpus_pipeline.run(spark, path).count() == packed.count()


def test_clean_documents_stay(spark, sf):
    raw, toxic, near, clean, masked, packed = stages(spark, sf)
    assert toxic.count() > 0.85 * raw.count()
    assert {r.doc_id for r in masked.collect()} == {r.doc_id for r in packed.collect()}
    assert all(not secrets.Scanner().base(r.text) for r in masked.collect())


def test_empty(spark, tmp_path):
    path = docs.write(spark, tmp_path, [], benchmark=bench(spark, []), labels=labels(spark, []))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_null_ids_and_extra_columns_pass(spark, tmp_path):
    rows = docs.rows(["a b c d e f g", None, "h i j"])
    rows[0] = (None, *rows[0][1:])
    spark.createDataFrame(rows, docs.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3


def test_contaminated_rows_go_whatever_their_ids(spark, tmp_path):
    rows = [(None, ITEM, 1), (None, "clean words stand here", 2), (7, ITEM, 3), (7, "clean words under the same id", 4), (8, "tie", 5), (8, "tie", 6), (9, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    bench(spark, [(1, ITEM, 1)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path))
    assert kept.columns == df.columns and sorted(r.row for r in kept.collect()) == [2, 4, 5, 6, 7]


def test_repeated_ids_and_rows_through_all_stages(spark, tmp_path):
    texts = ["one two three four five six seven eight", "nine ten eleven twelve words of another kind"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[0] + " and more"), (None, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, []).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((str(r.doc_id), r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert {k for k, _, _ in got} >= {"1", "None"} and not [k for k, _, _ in got if k == "2"]
