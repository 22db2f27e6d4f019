"""Collections over existing tables, and the registry of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidName
from ..functions.names import check_name, make_key, short_code
from ..operators import keys
from ..operators.select import ID


class Registry:
    """Names of collections and their short codes; two names with one code are refused."""

    def __init__(self) -> None:
        self.codes: dict[str, str] = {}

    def code(self, name: str) -> str:
        own = check_name(name)
        code = short_code(own)
        other = self.codes.setdefault(code, own)
        if other != own:
            raise InvalidName(f"{own!r} and {other!r} have the same short code {code}")
        return code


def from_table(df: DataFrame, name: str, key: str, refs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A table as a collection: ``$ID`` from its key, and references (column -> (new column, collection)).

    The columns of ids remember the columns they are made of, so lookups and joins by id
    become ones by key (``operators/keys.py``).
    """
    made = {ID: (short_code(check_name(name)), key)} | {new: (short_code(target), column) for column, (new, target) in (refs or {}).items()}
    out = df.select(make_key(made[ID][0], F.col(key)).alias(ID, metadata=keys.made_from(df, *made[ID])), "*")
    for new, (code, column) in made.items():
        if new != ID:
            out = out.withColumn(new, F.when(F.col(column).isNotNull(), make_key(code, F.col(column))).alias(new, metadata=keys.made_from(df, code, column)))
    return out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
