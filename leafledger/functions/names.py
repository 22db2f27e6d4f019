"""Collection names, short type codes and document keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidName, InvalidSelector

ALPHABET = "0123456789abcdefghjkmnpqrtuvwxyz"
NAME = r"^[a-z0-9]*[a-rt-z0-9]S?$"


def check_name(name: str) -> str:
    """The singular name; raises for names outside the grammar."""
    if not isinstance(name, str) or not re.match(NAME, name):
        raise InvalidName(f"invalid collection name: {name!r}")
    return name.removesuffix("S")


def short_code(name: str) -> str:
    """First two and last two letters, upper-cased; a trailing plural S does not count."""
    base = name.removesuffix("S")
    return (base[:2] + base[-2:]).upper()


def short_code_col(name: Column) -> Column:
    base = F.regexp_replace(name, "S$", "")
    return F.upper(F.concat(F.substring(base, 1, 2), F.right(base, F.lit(2))))


def valid_name_col(name: Column) -> Column:
    return name.rlike(NAME)


def bare_key(key: Column) -> Column:
    """The key without the wrapper of deleted documents, ``X:<key>:X``."""
    return F.regexp_replace(key, "^X:(.*):X$", "$1")


def key_type(key: Column) -> Column:
    return F.substring_index(bare_key(key), "_", 1)


def key_id(key: Column) -> Column:
    """What follows the first ``_``; the whole key if there is none."""
    bare = bare_key(key)
    return F.when(F.instr(bare, "_") > 0, F.substr(bare, F.instr(bare, "_") + 1)).otherwise(bare)


def deleted_key(key: Column) -> Column:
    return F.concat(F.lit("X:"), key, F.lit(":X"))


def is_deleted(key: Column) -> Column:
    return key.rlike("^X:.*:X$")


def make_key(code: str, part: Column) -> Column:
    return F.concat(F.lit(f"{code}_"), part.cast("string"))


def derived_id(*parts: Column) -> Column:
    """Seven symbols of the id alphabet from a hash of the parts: repeatable on retries."""
    h = F.xxhash64(*parts)
    return F.concat(*[F.substr(F.lit(ALPHABET), (F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(7)])


def check_id(code: str, key: str) -> str:
    """An id must be ``CODE_...``."""
    if not isinstance(key, str) or not key.startswith(f"{code}_") or len(key) == len(code) + 1:
        raise InvalidSelector(f"{key!r} is no id of type {code}")
    return key


def valid_id_col(code: str, key: Column) -> Column:
    """Whether keys are ids of a type."""
    return key.startswith(f"{code}_") & (F.length(key) > len(code) + 1)
