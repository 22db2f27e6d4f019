import os

import pytest
from pyspark.sql import functions as F

from leafledger import middleware
from leafledger.errors import InvalidName, InvalidSelector, NotFound, TransactionError, ValidationError
from leafledger.operators import refs
from leafledger.operators.validate import Rule
from leafledger.session import Database

ID = "$ID"


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def names(df, column="name"):
    return sorted(str(r[column]) for r in df.collect())


def test_add_get_update_replace_delete(spark, db, tmp_path):
    new = db.add("user", [{"name": "Alice", "age": 30}, {"name": "Bob", "age": 20}])
    rows = {r.name: r for r in new.collect()}
    alice = rows["Alice"][ID]
    assert alice.startswith("USER_") and len(alice) == 12 and rows["Alice"].createdAt == rows["Alice"].updatedAt
    assert names(db.get("user", alice)) == ["Alice"] and names(db.get("userS")) == ["Alice", "Bob"]
    assert names(db.get("userS", lambda u: u.age > 25)) == ["Alice"] and names(db.get("userS", {"age": 20})) == ["Bob"]
    assert [r.name for r in db.get("userS", [alice, "USER_0000000", alice]).collect()] == ["Alice", None, "Alice"]
    db.update("user", alice, {"age": 31})
    got = db.get("user", alice).first()
    assert got.age == 31 and got.name == "Alice" and got.updatedAt > got.createdAt
    db.set("user", {ID: alice, "name": "Alicia"})
    again = db.get("user", alice).first()
    assert again.name == "Alicia" and again.age is None and again.createdAt == got.createdAt
    db.drop("user", alice, "name")
    assert db.get("user", alice).first().name is None
    db.delete("user", alice, "USER_admin00")
    assert db.get("user", alice).count() == 0 and names(db.get("userS")) == ["Bob"]
    gone = db.documents("user", deleted=True).first()
    assert gone[ID] == f"X:{alice}:X" and gone.deletedBy == "USER_admin00"
    assert db.sets().count() == 1
    with pytest.raises(NotFound):
        db.delete("user", alice, "USER_admin00")
    db.snapshot()
    db.add("user", {"name": "Carol", "age": 1})
    assert names(Database(spark, db.path).get("userS")) == ["Bob", "Carol"]


def test_selectors_and_names(db):
    for bad in ("users", "user-name", "user_name", ""):
        with pytest.raises(InvalidName):
            db.get(bad, "USER_1")
    db.declare("account", "n int")
    with pytest.raises(InvalidName):
        db.declare("accident", "n int")
    for call in (lambda: db.get("user"), lambda: db.get("user", "ITEM_1"), lambda: db.get("user", "USER"), lambda: db.get("user", ["USER_1"]), lambda: db.get("userS", 5), lambda: db.add("user", {ID: "USER_1", "a": 1}), lambda: db.set("user", {"a": 1})):
        with pytest.raises(InvalidSelector):
            call()
    with pytest.raises(NotImplementedError):
        db.pin("user")


def test_transaction(spark, db):
    a = db.add("item", {"value": 1}).first()[ID]
    other = Database(spark, db.path)
    own = db.rec()
    db.update("item", a, {"value": 2})
    db.update("item", a, {"value": 3})
    db.add("item", {"value": 9})
    assert names(db.get("itemS"), "value") == ["3", "9"] and names(other.get("itemS"), "value") == ["1"]
    assert db.pending() == [own]
    assert db.txn_status()["documents"] == 2
    assert db.pop() and names(db.get("itemS"), "value") == ["3"]
    assert db.pop() and names(db.get("itemS"), "value") == ["2"]
    db.fin()
    assert db.pending() == [] and names(Database(spark, db.path).get("itemS"), "value") == ["2"]
    db.rec()
    db.delete("item", a, "USER_1")
    assert db.get("itemS").count() == 0
    db.nop()
    assert names(db.get("itemS"), "value") == ["2"]
    assert db.log().where("action = 'SET'").count() == 2
    for call in (db.fin, db.nop, db.pop):
        with pytest.raises(TransactionError):
            call()
    with pytest.raises(TransactionError):
        db.add("item", {"value": 1}, txn_id="txn_none")


def test_references_and_nested_documents_collapse(db):
    author = db.add("author", {"name": "Jane"}).first()
    db.declare("book", "title string, author string")
    nested = db.spark.createDataFrame([("Emma", (author[ID], "Jane"))], f"title string, author struct<`{ID}`: string, name: string>")
    db.add("book", nested)
    book = db.get("bookS").first()
    assert book.author == author[ID]
    assert refs.populate(db.get("bookS"), "author", db.get("authorS")).first().author.name == "Jane"


def test_middleware(db):
    seen = []
    remove = db.middleware.use(middleware.hooks({"*": lambda c: seen.append("*"), "add": lambda c: seen.append("add")}, {"add": lambda c: seen.append("after")}))
    db.middleware.use(middleware.validation({"user": {"name": Rule("string"), "age": Rule("number", required=False)}}))
    db.middleware.use(middleware.logging(seen.append))
    db.add("user", {"name": "A", "age": 1})
    assert seen[:2] == ["*", "add"] and seen[-1] == "after" and any("db add user" in str(x) for x in seen)
    with pytest.raises(ValidationError):
        db.add("user", [{"name": None, "age": 2}])
    remove()
    assert db.middleware.count() == 2
    db.middleware.clear()
    db.middleware.use(lambda ctx, next_: None)
    assert db.get("userS") is None


def test_encryption_at_rest(spark, tmp_path):
    key = os.urandom(32)
    db = Database(spark, str(tmp_path / "e"), key)
    db.add("user", {"name": "Secret-Alice"})
    db.snapshot()
    db.rec()
    db.add("user", {"name": "Secret-Bob"})
    raw = b"".join(open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path / "e") for f in fs if "tmp" not in d)
    assert b"Secret" not in raw
    assert names(db.get("userS")) == ["Secret-Alice", "Secret-Bob"]
    with pytest.raises(Exception, match="AES|decrypt|crypt"):
        Database(spark, str(tmp_path / "e"), os.urandom(32)).get("userS").collect()


def test_subscription(db):
    got = []
    db.add("user", {"name": "A"})
    db.add("item", {"name": "B"})
    db.sub("user", lambda df, n: got.extend(r.target for r in df.collect()), once=True).awaitTermination()
    assert len(got) == 1 and got[0].startswith("USER_")


def test_context_manager_snapshots(spark, tmp_path):
    with Database(spark, str(tmp_path / "x")) as db:
        db.add("user", {"name": "A"})
    assert os.path.exists(tmp_path / "x" / "snapshot" / "LATEST")
    assert names(Database(spark, str(tmp_path / "x")).get("userS", F.col("name") == "A")) == ["A"]


def test_archive_keeps_state_sets_and_positions(spark, db):
    a = db.add("user", [{"name": "A"}, {"name": "B"}]).where("name = 'A'").first()[ID]
    db.update("user", a, {"name": "A2"})
    assert db.checkpoint() == 2 and db._commits() == []
    assert db.log().count() == 5 and db.log(2).count() == 0
    db.add("user", {"name": "C"})
    db.delete("user", a, "USER_1")
    again = Database(spark, db.path)
    assert [line for line, _ in again._commits()] == [3, 4]
    assert names(again.get("userS")) == ["B", "C"] and again.sets().count() == 2
    assert again.archive() == 0 and again.checkpoint() == 4 and again.sets().count() == 2 and again.archive() == 0


def test_fetch_by_key_and_by_renamed_key(spark, db):
    a = db.add("user", {"name": "A"}).first()[ID]
    assert '"A"' in db.fetch(a) and db.fetch("USER_none") is None and '"A"' in db.fetch(a, txn_id="txn_unknown")
    from leafledger.plans import changelog

    db._append(spark.range(1).select(*changelog.entry("RENAME", F.lit("USER_new"), old_key=F.lit(a))), None, None, None)
    assert db.fetch(a) is None and '"A"' in db.fetch("USER_new")
    db.rec()
    db.update("user", "USER_new", {"name": "B"})
    assert '"B"' in db.fetch("USER_new") and '"A"' in db.fetch("USER_new", txn_id=None)


def test_update_is_validated(db):
    a = db.add("user", {"name": "A", "age": 1}).first()[ID]
    db.middleware.use(middleware.validation({"user": {"name": Rule("string"), "age": Rule("number", required=False)}}))
    with pytest.raises(ValidationError):
        db.update("user", a, {"name": None})
    db.update("user", a, {"age": 2})
    assert db.get("user", a).first().age == 2


def test_a_claimed_position_is_refused(spark, db):
    db.add("user", {"name": "A"})
    open(os.path.join(db.path, "log", "_claim-000000000002"), "w").close()
    with pytest.raises(TransactionError):
        db.add("user", {"name": "B"})
    os.remove(os.path.join(db.path, "log", "_claim-000000000002"))
    db.add("user", {"name": "B"})
    assert names(db.get("userS")) == ["A", "B"]


def test_subscribers_are_counted_and_cleared(db):
    db.add("user", {"name": "A"})
    q = db.sub("user", lambda df, n: None)
    assert db.subscriber_count("user") == 1 and db.subscriber_count("item") == 0
    db.clear_subscribers()
    assert not q.isActive and db.subscriber_count("user") == 0
