"""The façade: collections over a change log in a folder.

Reads are lazy DataFrames; a write appends one folder of log entries, which is renamed
into place whole and is one position (``line``) of the log.  A marker file that only one
writer can create claims a position.  State is the fold of the latest snapshot and the
log after it; commits that a snapshot covers can be archived.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .errors import InvalidSelector, NotFound, TransactionError
from .functions import codec, crypto
from .functions.names import check_id, check_name, deleted_key, derived_id, key_type
from .middleware import Chain
from .operators import changes, refs, select
from .operators.select import ID
from .plans import changelog, replay, txn
from .sources import files
from .sources.tables import Registry
from .streaming.subscribe import read_log, subscribe

LOG = "line long, ts timestamp, action string, target string, old_key string, member string, value string, save_by string, tag string"
_META = [T.StructField(ID, T.StringType()), T.StructField("createdAt", T.TimestampType()), T.StructField("updatedAt", T.TimestampType())]


class Database:
    """``get``, ``add``, ``set``, ``update``, ``delete``, ``sub``; ``rec``, ``fin``, ``nop``, ``pop``.

    A collection's plural (``userS``) reads all matches, the singular the first one by id.
    With ``key`` (32 bytes) every stored value is encrypted, bound to its target.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.registry, self.middleware, self.txn = Registry(), Chain(), None
        self._subscribers: list[tuple[str, StreamingQuery]] = []
        text = files.read_text_file(spark, f"{self.path}/schemas.json")
        self.schemas: dict[str, T.StructType] = {k: T.StructType.fromJson(v) for k, v in json.loads(text).items()} if text else {}
        for name in self.schemas:
            self.registry.code(name)
        self._dirs()

    # -- schema ---------------------------------------------------------------------------------

    def declare(self, name: str, schema: T.StructType | str) -> None:
        """Fields of a collection, beside the ones of every document."""
        own = check_name(name)
        self.registry.code(own)
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        old = {f.name: f for f in self.schemas.get(own, T.StructType())}
        merged = T.StructType(list((old | {f.name: f for f in kind if f.name not in {m.name for m in _META}}).values()))
        if merged != self.schemas.get(own):
            self.schemas[own] = merged
            files.publish(self.spark, f"{self.path}/schemas.json", json.dumps({k: v.jsonValue() for k, v in self.schemas.items()}))

    def _schema(self, own: str) -> T.StructType:
        return T.StructType(_META + list(self.schemas.get(own, T.StructType()).fields))

    # -- log ------------------------------------------------------------------------------------

    def _dirs(self) -> None:
        fs, p = files._fs(self.spark, f"{self.path}/log")
        fs.mkdirs(p)

    def _listed(self, folder: str, prefix: str) -> list[tuple[int, str]]:
        fs, p = files._fs(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n[2:]), f"{self.path}/{folder}/{n}") for n in names if n.startswith(prefix))

    def _commits(self) -> list[tuple[int, str]]:
        return self._listed("log", "c-")

    def _last_line(self) -> int:
        return max([0, *(line for line, _ in self._commits()), *(line for line, _ in self._listed("archive", "a-"))])

    def log(self, after: int = 0) -> DataFrame:
        """Entries after a line, values decrypted; archived ones only if ``after`` asks for them."""
        own = [p for line, p in self._listed("archive", "a-") if line > after] + [p for line, p in self._commits() if line > after]
        df = self.spark.read.schema(LOG).parquet(*own).where(F.col("line") > after) if own else self.spark.createDataFrame([], LOG)
        return df.withColumn("value", self._open(F.col("value"), F.col("target")))

    def _used(self) -> DataFrame:
        """Every key of the snapshot and of the log after it, also of the active transaction."""
        snap = files.read_snapshot(self.spark, f"{self.path}/snapshot")
        out = self.log(snap[1] if snap else 0).select(F.col("target").alias("key"))
        out = out.unionByName(snap[0].select("key")) if snap else out
        return out if self.txn is None else out.unionByName(self._actions(self.txn).select(F.col("target").alias("key")))

    def _seal(self, value: Column, target: Column) -> Column:
        return value if self.key is None else F.when(value.isNotNull(), crypto.encrypt(value, self.key, target))

    def _open(self, value: Column, target: Column) -> Column:
        return value if self.key is None else F.when(value.isNotNull(), crypto.decrypt(value, self.key, target))

    def _append(self, entries: DataFrame, save_by: str | None, tag: str | None, txn_id: str | None) -> None:
        """One commit of the log, or actions of an open transaction."""
        rows = entries.select(*changelog._FIELDS).withColumns({"ts": F.current_timestamp(), "save_by": F.lit(save_by).cast("string"), "tag": F.lit(tag).cast("string")})
        rows = rows.withColumn("value", self._seal(F.col("value"), F.col("target")))
        if txn_id is not None:
            self._known(txn_id)
            base, line = f"{self.path}/txn/{txn_id}", self._seq(txn_id) + 1
        else:
            base, line = f"{self.path}/log", self._last_line() + 1
        temp = f"{self.path}/tmp/{uuid.uuid4().hex}"
        schema = T._parse_datatype_string(LOG)
        rows.withColumn("line", F.lit(line).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(temp)
        fs, source = files._fs(self.spark, temp)
        _, target = files._fs(self.spark, f"{base}/c-{line:012d}")
        fs.mkdirs(target.getParent())
        claim = files._fs(self.spark, f"{base}/_claim-{line:012d}")[1]
        try:
            fs.create(claim, False).close()  # of several writers one succeeds
        except Py4JJavaError as e:
            raise TransactionError("another writer took this position of the log") from e
        try:
            if fs.exists(target) or not fs.rename(source, target):
                raise TransactionError("another writer took this position of the log")
        finally:
            fs.delete(claim, False)

    # -- state ----------------------------------------------------------------------------------

    def _committed(self, keys: list[str] | None = None) -> DataFrame:
        """The state; with ``keys`` of these only, by a fold of their own entries unless a rename brought one of them there."""
        snap = files.read_snapshot(self.spark, f"{self.path}/snapshot")
        log = self.log(snap[1] if snap else 0)
        state = snap and snap[0].withColumn("value", self._open(F.col("value"), F.col("key")))
        if keys is None:
            return replay.from_snapshot(state, snap[1], log) if snap else replay.documents(log)
        if not log.where((F.col("action") == "RENAME") & F.col("target").isin(keys)).isEmpty():
            return self._committed().where(F.col("key").isin(keys))
        own = log.where(F.col("target").isin(keys) | F.col("old_key").isin(keys))
        found = replay.from_snapshot(state.where(F.col("key").isin(keys)), snap[1], own) if snap else replay.documents(own)
        return found.where(F.col("key").isin(keys))

    def state(self, txn_id: str | None = "active", keys: list[str] | None = None) -> DataFrame:
        """(key, value) as seen now, of ``keys`` or all; ``txn_id=None`` leaves the active transaction out."""
        own = self.txn if txn_id == "active" else txn_id
        if own is None:
            return self._committed(keys).select("key", "value")
        seen = txn.overlay(self._committed().select("key", "value"), self._actions(own))
        return seen if keys is None else seen.where(F.col("key").isin(keys))

    def fetch(self, key: str, txn_id: str | None = "active") -> str | None:
        """The stored JSON of a key of any type, None if it is absent; an unknown transaction reads the main state."""
        own = self.txn if txn_id == "active" else txn_id
        row = self.state(own if own in self.pending() else None, [key]).first()
        return row and row["value"]

    def sets(self) -> DataFrame:
        snap = files.read_snapshot_sets(self.spark, f"{self.path}/snapshot")
        base = replay.sets(self.log()) if snap is None else txn.set_overlay(snap[0], self.log(snap[1]))
        return base if self.txn is None else txn.set_overlay(base, self._actions(self.txn))

    def snapshot(self) -> int:
        """Write the state and point to it; returns the line it stands for."""
        line, kept_txn, self.txn = self._last_line(), self.txn, None
        try:
            state = self._committed().select("key", self._seal(F.col("value"), F.col("key")).alias("value"))
            files.write_snapshot(state, f"{self.path}/snapshot", line, self.sets())
        finally:
            self.txn = kept_txn
        return line

    def archive(self) -> int:
        """Move the commits that the latest snapshot covers into one archived segment; returns how many there were."""
        snap = files.read_snapshot(self.spark, f"{self.path}/snapshot")
        old = [(line, p) for line, p in self._commits() if snap and line <= snap[1]]
        if old:
            temp = f"{self.path}/tmp/{uuid.uuid4().hex}"
            self.spark.read.schema(LOG).parquet(*[p for _, p in old]).write.parquet(temp)
            fs, source = files._fs(self.spark, temp)
            _, target = files._fs(self.spark, f"{self.path}/archive/a-{old[-1][0]:012d}")
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
            for _, p in old:
                fs.delete(files._fs(self.spark, p)[1], True)
        return len(old)

    def checkpoint(self) -> int:
        """Snapshot, then archive; an orchestrator calls it as often as it likes."""
        line = self.snapshot()
        self.archive()
        return line

    def documents(self, name: str, deleted: bool = False, txn_id: str | None = "active", keys: list[str] | None = None) -> DataFrame:
        """A collection (or the documents of some ``keys`` of it) as a DataFrame; with ``deleted`` its deleted documents."""
        own = check_name(name)
        code = self.registry.code(own)
        rows = self.state(txn_id, keys).where(key_type(F.col("key")) == code).where(F.col("key").startswith("X:") if deleted else ~F.col("key").startswith("X:"))
        schema = self._schema(own)
        if deleted:
            schema = T.StructType([*schema.fields, T.StructField("deletedAt", T.TimestampType()), T.StructField("deletedBy", T.StringType())])
        out = rows.select("key", codec.decode(F.col("value"), schema).alias("d")).select("key", "d.*")
        return out.withColumn(ID, F.col("key")).drop("key")

    # -- operations -----------------------------------------------------------------------------

    def _run(self, operation: str, name: str, fn: Callable[[dict], None], **more: Any) -> DataFrame | None:
        return self.middleware.run({"operation": operation, "collection": check_name(name), "db": self, **more}, fn)

    def get(self, name: str, selector: Any = None, deep: bool = False, txn_id: str | None = "active") -> DataFrame:
        """By id, object with ``$ID``, list of ids, query object, predicate function, or all of ``nameS``."""
        own = check_name(name)
        code, many = self.registry.code(own), name.endswith("S")
        if selector is None and not many:
            raise InvalidSelector("a selector is needed to get one document")
        if isinstance(selector, (list, tuple)) and not many:
            raise InvalidSelector("a list of ids needs the plural name")
        if selector is not None and not isinstance(selector, (str, dict, list, tuple, Column)) and not callable(selector):
            raise InvalidSelector(f"cannot select by {type(selector).__name__}")

        def final(ctx: dict) -> None:
            wanted = selector[ID] if isinstance(selector, dict) and ID in selector else selector
            keys = [wanted] if isinstance(wanted, str) else [k if k.startswith(f"{code}_") else f"{code}_{k}" for k in wanted] if isinstance(wanted, (list, tuple)) else None
            df = self.documents(own, txn_id=txn_id, keys=keys)
            if isinstance(selector, str) or (isinstance(selector, dict) and ID in selector):
                ctx["df"] = select.get_by_id(df, code, selector)
            elif isinstance(selector, (list, tuple)):
                ctx["df"] = select.get_by_ids(df, code, list(selector))
            else:
                got = select.where(df, selector, deep)
                ctx["df"] = got if many else got.orderBy(F.col(f"`{ID}`")).limit(1)

        return self._run("get", own, final)

    def _frame(self, own: str, rows: DataFrame | list[dict] | dict) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        listed = [rows] if isinstance(rows, dict) else rows
        known = self.schemas.get(own)
        if known and all(set(r) <= {*known.names, ID} for r in listed):
            fields = [f for f in self._schema(own) if any(f.name in r for r in listed)]
            return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in listed], T.StructType(fields))
        return self.spark.createDataFrame(listed)

    def _sets(self, docs: DataFrame) -> DataFrame:
        return docs.select(*changelog.entry("SET", F.col(f"`{ID}`"), codec.encode(docs.schema)))

    def add(self, name: str, rows: DataFrame | list[dict] | dict, save_by: str | None = None, tag: str | None = None, txn_id: str | None = "active") -> DataFrame:
        """Insert; returns the new documents.  Ids derive from one random value a call and the rows, so a retried task makes the same ones."""
        own = check_name(name)
        code, df = self.registry.code(own), self._frame(own, rows)
        if ID in df.columns:
            raise InvalidSelector("new documents must not have $ID")

        def final(ctx: dict) -> None:
            flat = refs.strip_refs(ctx["rows"])
            self.declare(own, flat.schema)
            salt = uuid.uuid4().hex
            # a row's id must not change when its task runs again: number the written rows once
            staged = f"{self.path}/tmp/{salt}"
            flat.withColumn("_n", F.monotonically_increasing_id()).write.parquet(staged)
            kept = self.spark.read.parquet(staged)
            key = F.concat(F.lit(f"{code}_"), derived_id(F.lit(salt), F.col("_n")))
            at = F.current_timestamp()
            docs = kept.select(key.alias(ID), *[F.col(f"`{c}`") for c in flat.columns], at.alias("createdAt"), at.alias("updatedAt"))
            # keys alone are read, nothing is folded: a key that was ever used is not used again
            new = docs.select(F.col(f"`{ID}`").alias("key"))
            again = new.groupBy("key").count().where("count > 1").select("key").unionByName(new.join(self._used(), "key", "left_semi"))
            if not again.isEmpty():
                longer = F.concat(F.lit(f"{code}_"), derived_id(F.lit(salt), F.col("_n")), derived_id(F.col("_n"), F.lit(salt)))
                docs = kept.select(longer.alias(ID), *[F.col(f"`{c}`") for c in flat.columns], at.alias("createdAt"), at.alias("updatedAt"))
            member = docs.select(*changelog.entry("SADD", F.lit(f"{code}?"), member=F.expr(f"substr(`{ID}`, {len(code) + 2})")))
            self._append(self._sets(docs).unionByName(member), save_by, tag, self.txn if txn_id == "active" else txn_id)
            keys = docs.select(F.col(f"`{ID}`").alias("_new"))
            now = self.documents(own)
            ctx["df"] = now.join(keys, now[f"`{ID}`"] == keys["_new"], "left_semi")

        return self._run("add", own, final, rows=df)

    def update(self, name: str, selector: Any, values: dict[str, Any], save_by: str | None = None, tag: str | None = None) -> None:
        """Set values at dotted paths of all selected documents; other branches stay as they are now."""
        own = check_name(name)
        if any(p.split(".")[0] in (ID, "createdAt", "updatedAt") for p in values):
            raise InvalidSelector("$ID, createdAt and updatedAt are not set by hand")

        def changed() -> DataFrame:
            docs = self.get(f"{own}S", [selector] if isinstance(selector, str) else selector)
            new = docs.drop("slot", "wanted").where(F.col(f"`{ID}`").isNotNull())
            for path, value in values.items():
                new = changes.set_path(new, path.split("."), value if isinstance(value, Column) else F.lit(value))
            return new

        def final(ctx: dict) -> None:
            new = ctx["rows"]
            self.declare(own, new.drop(ID, "createdAt", "updatedAt").schema)
            self._append(self._sets(new.withColumn("updatedAt", F.current_timestamp())), save_by, tag, self.txn)

        self._run("update", own, final, rows=changed())

    def drop(self, name: str, selector: Any, path: str) -> None:
        """Delete a field of the selected documents."""
        own = check_name(name)

        def final(ctx: dict) -> None:
            docs = self.get(f"{own}S", [selector] if isinstance(selector, str) else selector).drop("slot", "wanted").where(F.col(f"`{ID}`").isNotNull())
            self._append(self._sets(changes.drop_path(docs, path.split(".")).withColumn("updatedAt", F.current_timestamp())), None, None, self.txn)

        self._run("update", own, final)

    def set(self, name: str, rows: DataFrame | list[dict] | dict, save_by: str | None = None, tag: str | None = None) -> None:
        """Replace whole documents by id; their creation times stay."""
        own = check_name(name)
        code, df = self.registry.code(own), self._frame(own, rows)
        if ID not in df.columns:
            raise InvalidSelector("a document to set needs $ID")
        if isinstance(rows, (dict, list)):
            for r in [rows] if isinstance(rows, dict) else rows:
                check_id(code, r[ID])

        def final(ctx: dict) -> None:
            new = ctx["rows"]
            self.declare(own, new.drop(ID, "createdAt", "updatedAt").schema)
            old = self.documents(own).select(F.col(f"`{ID}`").alias("_id"), F.col("createdAt").alias("_created"))
            j = new.join(old, new[f"`{ID}`"] == old["_id"], "left")
            at = F.current_timestamp()
            docs = j.select(*[new[f"`{c}`"] for c in new.columns if c not in ("createdAt", "updatedAt")], F.coalesce("_created", at).alias("createdAt"), at.alias("updatedAt"))
            self._append(self._sets(docs), save_by, tag, self.txn)

        self._run("set", own, final, rows=df)

    def delete(self, name: str, keys: str | list[str], by: str) -> None:
        """Soft delete: the documents move to ``X:<id>:X`` with who and when."""
        own = check_name(name)
        code = self.registry.code(own)
        wanted = [check_id(code, k) for k in ([keys] if isinstance(keys, str) else keys)]

        def final(ctx: dict) -> None:
            docs = self.documents(own).where(F.col(f"`{ID}`").isin(wanted))
            found = docs.count()
            if found != len(set(wanted)):
                raise NotFound(f"{len(set(wanted)) - found} of the documents do not exist")
            dead = docs.withColumn("deletedAt", F.current_timestamp()).withColumn("deletedBy", F.lit(by))
            moved = dead.select(*changelog.entry("SET", deleted_key(F.col(f"`{ID}`")), codec.encode(dead.schema)))
            gone = docs.select(*changelog.entry("DELETE", F.col(f"`{ID}`")))
            out = docs.select(*changelog.entry("SREM", F.lit(f"{code}?"), member=F.expr(f"substr(`{ID}`, {len(code) + 2})")))
            self._append(moved.unionByName(gone).unionByName(out), by, None, self.txn)

        self._run("del", own, final)

    def pin(self, name: str) -> None:
        raise NotImplementedError("pin still needs to be implemented")

    def sub(self, name: str, callback: Callable[[DataFrame, int], None], once: bool = False):
        """Call back with each batch of committed entries of a collection; ``stop()`` on the result unsubscribes."""
        code = self.registry.code(check_name(name))
        stream = read_log(self.spark, f"{self.path}/log/c-*", LOG)
        stream = stream.withColumn("value", self._open(F.col("value"), F.col("target")))
        query = subscribe(stream.where("action in ('SET', 'DELETE', 'RENAME')"), code, callback, f"{self.path}/sub/{uuid.uuid4().hex}", once=once)
        self._subscribers.append((code, query))
        return query

    def subscriber_count(self, name: str) -> int:
        """Running subscriptions of this session to a collection."""
        code = self.registry.code(check_name(name))
        return sum(c == code and q.isActive for c, q in self._subscribers)

    def clear_subscribers(self) -> None:
        for _, query in self._subscribers:
            query.stop()
        self._subscribers.clear()

    # -- transactions ---------------------------------------------------------------------------

    def rec(self) -> str:
        """Begin; reads and writes of this session see the transaction until it ends."""
        self.txn = f"txn_{uuid.uuid4().hex}"
        fs, p = files._fs(self.spark, f"{self.path}/txn/{self.txn}")
        fs.mkdirs(p)
        return self.txn

    def _known(self, txn_id: str) -> None:
        fs, p = files._fs(self.spark, f"{self.path}/txn/{txn_id}")
        if not fs.exists(p):
            raise TransactionError(f"no transaction {txn_id}")

    def _parts(self, txn_id: str) -> list[str]:
        self._known(txn_id)
        fs, p = files._fs(self.spark, f"{self.path}/txn/{txn_id}")
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("c-"))

    def _seq(self, txn_id: str) -> int:
        parts = self._parts(txn_id)
        return int(parts[-1].rpartition("-")[2]) if parts else 0

    def _actions(self, txn_id: str) -> DataFrame:
        parts = self._parts(txn_id)
        df = self.spark.read.schema(LOG).parquet(*parts) if parts else self.spark.createDataFrame([], LOG)
        return df.withColumn("value", self._open(F.col("value"), F.col("target")))

    def _active(self, txn_id: str | None) -> str:
        own = txn_id or self.txn
        if own is None:
            raise TransactionError("no transaction is active")
        self._known(own)
        return own

    def fin(self, txn_id: str | None = None) -> dict[str, int]:
        """Commit as one position of the log; returns the numbers of its status."""
        own = self._active(txn_id)
        numbers = self.txn_status(own)
        actions = self._actions(own)
        if numbers["actions"]:
            squashed = txn.squash(actions, self._committed().select("key", "value")).withColumn("old_key", F.lit(None).cast("string"))
            self._append(squashed, None, own, None)
        self.nop(own)
        return numbers

    def nop(self, txn_id: str | None = None) -> None:
        """Roll back."""
        own = self._active(txn_id)
        fs, p = files._fs(self.spark, f"{self.path}/txn/{own}")
        fs.delete(p, True)
        if own == self.txn:
            self.txn = None

    def pop(self, txn_id: str | None = None) -> bool:
        """Undo the last write of the transaction, whole; false if there is none."""
        parts = self._parts(self._active(txn_id))
        if not parts:
            return False
        fs, p = files._fs(self.spark, parts[-1])
        return fs.delete(p, True)

    def txn_status(self, txn_id: str | None = None) -> dict[str, int]:
        return {k: v for k, v in txn.status(self._actions(self._active(txn_id))).first().asDict().items() if k != "created_at"}

    def pending(self) -> list[str]:
        """Transactions that were begun and neither committed nor rolled back, also by earlier sessions."""
        fs, p = files._fs(self.spark, f"{self.path}/txn")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        if self._commits():
            self.snapshot()
