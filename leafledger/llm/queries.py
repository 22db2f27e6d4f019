"""The registered queries of this subpackage: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media
    from .store import shared_dir

    folder = shared_dir(spark)
    media.store_media(table(spark, sf_dir, "documents"), folder)
    return media.read_media(spark, folder).withColumnRenamed("key", "doc_id").drop("payload")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents.withColumn("held_out", toxicity.held_out()), model, ["doc_id", "held_out"])


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import read_shards, write_shards
    from .store import shared_dir
    from .tokens import default_tokenizer

    folder = shared_dir(spark)
    write_shards(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_shards(spark, folder).withColumnRenamed("key", "doc_id")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import default_tokenizer

    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    documents = table(spark, sf_dir, "documents")
    found = pii.scan_pii(documents, pii.fit(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import shared_dir
    from .warc import read_warc, write_warc

    folder = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    read = read_warc(spark, folder, payloads=False)
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    names = sorted((n for n in own if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))
    return {"pipeline": pipeline, **{n: own[n] for n in names}}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "op3_superminhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v WHERE r.root < u.b),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM s JOIN c ON v = doc_id""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), t AS (SELECT page_id, html, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS target FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN target <> page_id THEN target END AS refers_to FROM t""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return dict(SQL)
