"""Small awkward documents shared by the tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType()),
])
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
BODY = "the quick brown fox jumps over a lazy dog while seven wizards box with four jugs of old liquor near the river bank in spring"
TEXTS = [
    BODY, BODY, BODY + " again", None, "", " \t\n ", "one", "one two", "ONE two", "Ünï çödé ñ ß 漢字 😀 é", LONG, LONG + " tail", "x" * 5000, BODY.upper(), "\x00\x01 nul", "a\r\nb",
]


def rows(texts=TEXTS, first=0):
    return [(first + i, t, None if i % 3 else "en", f"src{i % 2}", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def write(spark, path, texts=TEXTS, **tables):
    frame(spark, texts).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
