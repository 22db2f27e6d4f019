"""Writes as views over a collection, and diffs between states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidSelector
from ..functions.names import deleted_key, derived_id, make_key
from ..functions.paths import flatten_paths, pointer
from .refs import strip_refs
from .select import ID

META = (ID, "createdAt", "updatedAt")


def add_documents(rows: DataFrame, code: str, at: Column, id_from: Column | None = None) -> DataFrame:
    """New documents: an id, equal creation and update times, references collapsed to ids."""
    if ID in rows.columns:
        raise InvalidSelector("new documents must not have $ID")
    own = strip_refs(rows)
    key = make_key(code, id_from) if id_from is not None else F.concat(F.lit(f"{code}_"), derived_id(F.expr("uuid()")))
    return own.select(key.alias(ID), *[F.col(f"`{c}`") for c in own.columns], at.alias("createdAt"), at.alias("updatedAt"))


def update_documents(base: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Overlay ``changes`` (``$ID``, changed columns, ``_declared`` array of the columns each row sets).

    A declared null is stored; rows whose declared values all equal the stored ones keep
    their update time.
    """
    c = changes.select(F.col(f"`{ID}`").alias("_id"), "_declared", *[F.col(f"`{n}`").alias(f"_new_{n}") for n in changes.columns if n not in (ID, "_declared")])
    j = base.join(c, base[f"`{ID}`"] == c["_id"], "left")
    out, changed = [], F.lit(False)
    for n in base.columns:
        if f"_new_{n}" in c.columns and n not in META:
            declared = F.coalesce(F.array_contains("_declared", n), F.lit(False))
            value = F.when(declared, F.col(f"`_new_{n}`")).otherwise(base[f"`{n}`"])
            changed |= declared & ~base[f"`{n}`"].eqNullSafe(F.col(f"`_new_{n}`"))
            out.append(value.alias(n))
        else:
            out.append(base[f"`{n}`"])
    if "updatedAt" in base.columns:
        k = base.columns.index("updatedAt")
        out[k] = F.when(changed, at).otherwise(base["updatedAt"]).alias("updatedAt")
    return j.select(*out)


def replace_documents(base: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Whole rows replace those with their ids; creation times stay."""
    kept = base.join(rows.select(ID), ID, "left_anti")
    created = base.select(F.col(f"`{ID}`").alias("_id"), F.col("createdAt").alias("_created"))
    new = rows.join(created, rows[f"`{ID}`"] == created["_id"])
    return kept.unionByName(new.select(*[rows[f"`{n}`"] for n in rows.columns if n not in ("createdAt", "updatedAt")], F.col("_created").alias("createdAt"), at.alias("updatedAt")), allowMissingColumns=True).select(*base.columns)


def soft_delete(base: DataFrame, gone: DataFrame, by: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(live rows, deleted rows under the key ``X:<id>:X`` with who and when)."""
    g = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    live = base.join(g, base[f"`{ID}`"] == g["_gone"], "left_anti")
    dead = base.join(g, base[f"`{ID}`"] == g["_gone"], "left_semi")
    return live, dead.withColumn(ID, deleted_key(F.col(f"`{ID}`"))).withColumn("deletedAt", at).withColumn("deletedBy", F.lit(by))


def restore(live: DataFrame, dead: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows and the deleted ones that are named, under their own ids."""
    from ..functions.names import bare_key

    k = keys.select(F.col(keys.columns[0]).alias("_back")).distinct()
    back = dead.withColumn(ID, bare_key(F.col(f"`{ID}`")))
    return live.unionByName(back.join(k, back[f"`{ID}`"] == k["_back"], "left_semi").drop("deletedAt", "deletedBy"))


def find_or_create(base: DataFrame, wanted: DataFrame, on: list[str], make) -> DataFrame:
    """``base`` and a new row, made by ``make(df)``, for each wanted one that it lacks."""
    lacking = wanted.dropDuplicates(on).join(base.select(*on), on, "left_anti")
    return base.unionByName(make(lacking), allowMissingColumns=True)


def patch(old: DataFrame, new: DataFrame, key: str = ID) -> DataFrame:
    """(key, op, path, value): what turns old rows into new ones, as add, replace and remove."""
    names = [c for c in old.columns if c != key]
    if {c for c in new.columns if c != key} != set(names):
        raise InvalidSelector("both states need the same columns")
    a = flatten_paths(old, key, names).select(key, pointer(F.col("path")).alias("path"), F.col("value").alias("was"), F.lit(True).alias("in_old"))
    b = flatten_paths(new, key, names).select(key, pointer(F.col("path")).alias("path"), "value", F.lit(True).alias("in_new"))
    op = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "remove").when(~F.col("was").eqNullSafe(F.col("value")), "replace")
    return a.join(b, [key, "path"], "full").withColumn("op", op).where("op is not null").select(key, "op", "path", F.when(F.col("op") != "remove", F.col("value")).alias("value"))


def apply_patch(flat: DataFrame, changes: DataFrame, key: str = ID) -> DataFrame:
    """Apply (key, op, path, value) to flattened rows (key, path, value)."""
    c = changes.select(key, "path", "op", F.col("value").alias("_new"))
    j = flat.join(c, [key, "path"], "full").where("op is null or op <> 'remove'")
    return j.select(key, "path", F.when(F.col("op").isNotNull(), F.col("_new")).otherwise(F.col("value")).alias("value"))


def events(changes: DataFrame, key: str, action: Column, at: Column, save_by: str, tag: str) -> DataFrame:
    """One change event for each document: its patch operations in order, with who, what and when."""
    ops = F.array_sort(F.collect_list(F.struct("path", "op", "value")))
    grouped = changes.groupBy(key).agg(F.transform(ops, lambda x: F.struct(x["op"].alias("op"), x["path"].alias("path"), x["value"].alias("value"))).alias("patches"))
    return grouped.select(
        F.sha2(F.concat_ws("|", F.col(key).cast("string"), at.cast("string")), 256).substr(1, 16).alias("event_id"),
        action.alias("action"), F.col(key).alias("target"), F.substring_index(F.col(key).cast("string"), "_", 1).alias("type"), F.lit(save_by).alias("save_by"), F.lit(tag).alias("tag"), at.alias("created_at"), "patches",
    )


def set_path(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    """Overlay one nested value, keeping its siblings; a missing struct on the way is made."""
    if len(path) == 1:
        return df.withColumn(path[0], value)
    kind = df.schema[path[0]].dataType if path[0] in df.columns else T.StructType()

    def put(root: Column | None, kind: T.StructType, rest: list[str]) -> Column:
        own = {f.name: (root.getField(f.name) if root is not None else F.lit(None).cast(f.dataType)) for f in kind.fields}
        if len(rest) == 1:
            own[rest[0]] = value
        else:
            inner = kind[rest[0]].dataType if rest[0] in kind.names else T.StructType()
            own[rest[0]] = put(own.get(rest[0]), inner, rest[1:])
        return F.struct(*[c.alias(n) for n, c in own.items()])

    return df.withColumn(path[0], put(F.col(f"`{path[0]}`") if path[0] in df.columns else None, kind, path[1:]))


def drop_path(df: DataFrame, path: list[str]) -> DataFrame:
    """Remove a field, at any depth."""
    if len(path) == 1:
        return df.drop(path[0])
    return df.withColumn(path[0], F.col(f"`{path[0]}`").dropFields(".".join(path[1:])))
