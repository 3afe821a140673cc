"""Stores and database (A1-A19), indexes (B1-B6, E3-E4), clocks and replication (J8-J13), streams (J1-J6), rates (E1-E2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.database import Database, Replication, Transaction
from docloom.functions import vclock
from docloom.functions.scalars import format_position, parse_position
from docloom.operators import changelog, flatten, indexes, rates
from docloom.operators.indexes import Catalog, IndexDef, IndexNotFound
from docloom.sources import csvload
from docloom.streaming import follow


@pytest.fixture(params=["memory", "disk"])
def db(spark, tmp_path, request):
    return Database(spark, None if request.param == "memory" else str(tmp_path / "db"), "one")


def test_a1_a5_documents(db):
    db.bulk([{"operation": "docs-put", "id": "1", "document": {"name": "bob", "tags": ["x"]}}, {"operation": "docs-put", "id": "2", "document": [1, 2]}, {"operation": "docs-put", "id": "2", "document": "text"}])
    assert db.load_document("1") == {"name": "bob", "tags": ["x"]} and db.load_document("2") == "text" and db.load_document("3") is None
    db.delete_document("1")
    assert db.load_document("1") is None and db.load_document_metadata("1")["synctag"] == 3
    assert db.load_document_metadata("9") is None
    with pytest.raises(ValueError, match="unknown operation"):
        db.bulk([{"operation": "?", "id": "1"}])


def test_j10_conflicts(db):
    db.put_document("1", {"v": 1})
    old = db.load_document_metadata("1")
    db.put_document("1", {"v": 2}, old)
    db.put_document("1", {"v": 3}, old)
    db.put_document("10", {"v": 1})
    db.delete_document("10", {"history": {"other": 1}})
    assert db.load_document("1") == {"v": 2}
    assert [(r.id, r.deleted) for r in db.conflicts().orderBy("seq").collect()] == [("1", False), ("10", True)]
    db.clear_conflicts("1")
    assert [r.id for r in db.conflicts().collect()] == ["10"] and db.conflicts("1").count() == 0


def test_queries_over_documents(db):
    docs = {"a": {"name": "zebra", "number": 25, "in": {"side": [1, 2]}}, "b": {"name": "aardvark", "number": 500}, "c": {"name": "zebra crossing", "number": 2.5, "flag": True}, "d": "just text"}
    db.bulk([{"operation": "docs-put", "id": k, "document": v} for k, v in docs.items()])
    assert db.query('(= "name" "zebra")') == [docs["a"]]
    assert db.query("(< :number 26)".replace(":number", '"number"')) == [docs["a"], docs["c"]]
    assert db.query('(= "in$side" 2)') == [docs["a"]]
    assert db.query('(= "value" "just text")') == [docs["d"]]
    assert db.query("*", sort_by="name", sort_order="desc", amount=2) == [docs["c"], docs["a"]]
    assert db.query("*", offset=3, amount=5) == [docs["d"]]
    db.put_index(IndexDef.of("by_name", {"n": "cast(variant_get(doc, '$.name', 'string') as string)"}, "id <> 'b' and schema_of_variant(doc) like 'OBJECT%'"))
    assert db.query('(starts-with "n" "zeb")', index="by_name") == [docs["a"], docs["c"]]
    db.delete_document("a")
    assert db.query('(= "n" "zebra")', index="by_name") == []
    assert [x["id"] for x in db.stream(after=1)] == ["b", "c", "d", "a"]
    with pytest.raises(IndexNotFound):
        db.query("*", index="nope")


def test_a14_indexes_outlive_the_process(spark, tmp_path):
    path = str(tmp_path / "db")
    first = Database(spark, path)
    first.put_document("a", {"name": "zebra"})
    by_name = IndexDef.of("by_name", {"n": "variant_get(doc, '$.name', 'string')"}, "id <> 'b'")
    first.put_index(by_name)
    first.put_index(IndexDef.of("gone", {"n": "id"}))
    first.delete_index("gone")
    first.catalog.advance("by_name", 7)
    first.catalog.mark_failed("by_name")
    again = Database(spark, path)
    assert again.catalog.ids() == ["default", "by_name"] and again.load_index("by_name") == by_name
    assert again.load_index_metadata("by_name") == {"version": 1, "last_seq": 7, "failed": True} and again.catalog.is_failed("by_name")
    assert again.query('(= "n" "zebra")', index="by_name") == []  # a failed index is left out of passes
    again.catalog.reset("by_name")
    assert again.query('(= "n" "zebra")', index="by_name") == [{"name": "zebra"}]
    again.put_index(by_name)
    again.put_index(IndexDef.of("by_name", {"n": "id"}))
    assert Database(spark, path).load_index_metadata("by_name") == {"version": 2, "last_seq": 0, "failed": False}
    # Its first version goes on serving until the second has caught up.
    late = Database(spark, path)
    assert late.query('(= "n" "zebra")', index="by_name", wait=False) == [{"name": "zebra"}]
    assert late.query('(= "n" "a")', index="by_name") == [{"name": "zebra"}] and late.catalog.is_promoted("by_name")


def test_a15_j1_j5_stored_indexes(db):
    db.bulk([{"operation": "docs-put", "id": str(i), "document": {"name": f"n{i}", "word": "blue " * (i + 1) + "sky"}} for i in range(3)])
    assert db.query('(= "name" "n1")', wait=False) == []  # nothing is indexed yet
    assert len(db.query()) == 3 and ("indexed", 3) in db.events
    db.put_document("1", {"name": "new"})
    db.delete_document("2")
    assert db.query('(= "name" "n1")', wait=False) == [{"name": "new"}]  # the old entry finds the new document
    assert len(db.query(wait=False, amount=2)) == 2  # what is deleted is left out before the page is cut
    assert db.query('(= "name" "n1")') == [] and db.query('(= "name" "new")') == [{"name": "new"}]
    assert db.indexer.stats["default"] == {"total": 2, "errors": 0, "indexed": 1, "messages": []}
    assert db.indexer.doc_count == 0 and list(db.pages(1)) == db.query()


def test_g3_best_match_first(db):
    docs = {"a": {"t": "zoo far away from here"}, "b": {"t": "zoo zoo zoo"}, "c": {"t": ["nothing", "zoo here"]}, "d": {"t": "none"}}
    db.bulk([{"operation": "docs-put", "id": k, "document": v} for k, v in docs.items()])
    assert db.query('(has-word "t" "zoo")') == [docs["b"], docs["c"], docs["a"]]
    assert db.query('(has-word "t" "zoo")', sort_by="t") == [docs["c"], docs["a"], docs["b"]]


def test_b1_k1_broken_indexes(db):
    def mapper(doc):
        if doc["n"] % 10:
            raise RuntimeError(f"broken {doc['n']}")
        return {"n": doc["n"]}

    valid = IndexDef.of("valid", {"n": "variant_get(doc, '$.n', 'bigint')"})
    db.put_index(valid)
    db.put_index(IndexDef.of("broken", {"n": "bigint"}, python="mapper"), mapper)
    db.put_index(IndexDef.of("raises", {"n": "raise_error('no')"}))
    db.bulk([{"operation": "docs-put", "id": f"{i:03}", "document": {"n": i * 10 if i < 30 else i}} for i in range(40)])
    assert db.query('(= "n" 20)', index="broken") == [{"n": 20}]
    assert db.indexer.stats["broken"]["errors"] == 9 and db.indexer.stats["broken"]["messages"][0] == "RuntimeError: broken 31"
    db.put_document("002", {"n": 21})
    assert db.query('(= "n" 20)', index="broken") == [{"n": 21}]  # the old entry stays
    db.bulk([{"operation": "docs-put", "id": f"x{i:03}", "document": {"n": 1}} for i in range(101)])
    db.indexer.drain()
    assert [db.catalog.is_failed(i) for i in ("default", "valid", "broken", "raises")] == [False, False, True, True]
    assert len(db.query('(= "n" 1)', index="valid")) == 101 and db.query('(= "n" 1)', index="broken") == []
    db.put_index(IndexDef.of("broken", {"n": "variant_get(doc, '$.n', 'bigint')"}))
    assert len(db.query('(= "n" 1)', index="broken")) == 101 and not db.catalog.is_failed("broken")


def test_g8_d2_passes(db):
    db.indexer.pass_rows = 4
    db.put_index(IndexDef.of("i", {"v": "variant_get(doc, '$', 'bigint')"}))
    db.indexer.drain()
    db.bulk([{"operation": "docs-put", "id": str(i), "document": i} for i in range(6)])
    assert db.indexer.run_pass(["default", "i"], 4) == 8 and db.catalog.last_seq("i") == 4
    assert db.query("*", index="i", wait=False) == [0, 1, 2, 3] and db.query("*", index="i") == [0, 1, 2, 3, 4, 5]
    defs = db.spark.createDataFrame([("a", 2), ("b", 3)], "index_id string, by int")
    got = {tuple(r) for r in indexes.pass_stats(db.spark.range(6), defs, F.col("id") % F.col("by") == 0).collect()}
    assert got == {("a", 6, 3, 3), ("b", 6, 2, 4)}


def test_j12_l2_transactions_in_flight(db):
    db.put_document("1", {"v": 0})
    seen = db.load_document_metadata("1")
    one, two = db.open(), db.open()
    db.add_document(one, "1", {"v": 1}, seen)
    db.add_document(two, "1", {"v": 2}, seen)  # the first writer's history is newer than what this one has seen
    db.remove_document(two, "3")
    assert db.load_document("1") == {"v": 0}
    db.complete(two)
    db.complete(one)
    assert db.load_document("1") == {"v": 1} and [r.id for r in db.conflicts().collect()] == ["1"] and not db.in_flight
    three = db.open()
    db.add_document(three, "1", {"v": 3})
    db.clean_up(three)
    db.put_document("1", {"v": 4})
    assert db.load_document("1") == {"v": 4} and not db._writing


def test_j9_replication_control(spark, db):
    source = Database(spark, server_id="source")
    source.bulk([{"operation": "docs-put", "id": str(i), "document": i} for i in range(7)])
    handle = Replication(db, source, "source", rows=3)
    assert not handle.wait_for(7, 100)
    handle.start()
    assert handle.wait_for(7, 60_000)
    handle.stop()
    assert handle.status() == {"last_synctag": 7, "total": 1} and db.load_document("6") == 6


def test_a10_compaction(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    for i in range(4):
        db.put_document(str(i % 2), {"v": i})
    db.store.compact()
    assert len(list((tmp_path / "db" / "log").glob("*.parquet"))) == 1 and db.store.log().count() == 4
    db.put_document("0", {"v": 9})
    assert db.query('(= "v" 9)') == [{"v": 9}] and db.load_document_metadata("0")["synctag"] == 5


def test_l1_unit_of_work(db):
    db.put_document("1", {"v": 1})
    tx = Transaction(db).store("2", {"v": 2}).delete("1")
    assert tx.load("1") is None and tx.load("2") == {"v": 2} and db.load_document("2") is None
    tx.commit()
    assert db.load_document("1") is None and db.load_document("2") == {"v": 2}


def test_j8_replication(spark):
    one, two = Database(spark, server_id="one"), Database(spark, server_id="two")
    one.put_document("x", {"hello": 1})
    two.replicate(one.store.log())
    assert two.load_document("x") == {"hello": 1} and two.replication_status() == {"last_synctag": 1, "total": 1}
    two.replicate(one.store.log())
    assert two.store.log().count() == 1
    one.put_document("x", {"hello": "one"})
    two.put_document("x", {"hello": "two"})
    two.replicate(one.store.log())
    one.replicate(two.store.log())
    assert one.load_document("x") == {"hello": "one"} and two.load_document("x") == {"hello": "two"}
    assert one.conflicts().count() == two.conflicts().count() == 1
    one.delete_document("x")
    three = Database(spark, server_id="three")
    three.replicate(one.store.log())
    assert three.load_document("x") is None


def test_j1_j6_streams(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), "one")
    index, out = IndexDef.of("i", {"name": "variant_get(doc, '$.name', 'string')"}), str(tmp_path / "out")

    def catch_up():
        follow.follow_index(spark, f"{db.store.path}/log", index, out, str(tmp_path / "cp")).awaitTermination()
        return {(r.id, r.name) for r in follow.read_index(spark, out).collect()}

    db.bulk([{"operation": "docs-put", "id": str(i), "document": {"name": f"n{i}"}} for i in range(3)])
    assert catch_up() == {("0", "n0"), ("1", "n1"), ("2", "n2")}
    db.put_document("1", {"name": "new"})
    db.delete_document("2")
    db.put_document("0", {"other": 1})
    assert catch_up() == {("1", "new")}
    target = Database(spark, server_id="two")
    follow.follow_replica(spark, f"{db.store.path}/log", target, str(tmp_path / "cp2")).awaitTermination()
    assert target.load_document("1") == {"name": "new"} and target.load_document("2") is None


def test_log_operators(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("b", 2, "y", False), ("a", 3, "z", False), ("b", 4, None, True)], "id string, seq long, v string, deleted boolean")
    assert [tuple(r)[:3] for r in changelog.snapshot(log).collect()] == [("a", 3, "z")]
    assert [tuple(r) for r in changelog.after(log, 1).collect()] == [("b", 2), ("a", 3)]
    assert [r.id for r in changelog.feed(log, 0).collect()] == ["a", "b"]
    assert changelog.positions(log).first().newest == 4
    staged = spark.createDataFrame([("a", "new", False), ("c", None, True)], "id string, v string, deleted boolean")
    assert {tuple(r) for r in changelog.overlay(changelog.snapshot(log).select("id", "v"), staged).collect()} == {("a", "new")}


def test_clocks(spark):
    df = spark.sql("select map('a', 1L, 'b', 2L) x, map('b', 2L, 'a', 1L) y, map('a', 2L, 'b', 2L) z, map('c', 1L) w, cast(null as map<string,bigint>) n")
    row = df.select(vclock.same(F.col("x"), F.col("y")), vclock.descends(F.col("z"), F.col("x")), vclock.descends(F.col("x"), F.col("z")), vclock.replication_status(F.col("x"), F.col("w")), vclock.replication_status(F.col("n"), F.col("w")), vclock.client_status(F.col("x"), F.col("n")), vclock.increment(F.col("n"), F.lit("s"))["s"]).first()
    assert tuple(row) == (True, True, False, "conflict", "write", "conflict", 1)
    assert spark.range(1).select(format_position(F.lit(7)), parse_position(format_position(F.lit(7)))).first()[:] == ("0" * 29 + "7", 7)


def test_b1_b2_python_index_and_stats(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, title string")

    def mapper(doc):
        if doc["id"] == 3:
            raise RuntimeError("broken")
        return None if doc["id"] == 4 else {"t": doc["title"].upper()}

    built = indexes.build_python(df, "id", mapper, "t string", lambda doc: doc["id"] > 0)
    assert {(r.id, r.t, r.error) for r in built.collect()} == {(1, "T1", None), (2, "T2", None), (3, None, "RuntimeError: broken"), (5, "T5", None)}
    stats = indexes.stats(built, F.lit("i"), F.col("error").isNotNull())
    assert stats.first().errors == 1 and indexes.failed(stats).count() == 0 and indexes.failed(stats, over=3, ratio=0.2).count() == 1
    catalog = Catalog()
    catalog.put(IndexDef.of("x", {"a": "b"}))
    catalog.advance("x", 9)
    catalog.mark_failed("x")
    assert catalog.metadata("x") == {"version": 1, "last_seq": 9, "failed": True}
    catalog.put(IndexDef.of("x", {"a": "c"}))
    assert catalog.metadata("x") == {"version": 2, "last_seq": 0, "failed": False} and catalog.ids() == ["default", "x"]
    catalog.delete("x")
    with pytest.raises(IndexNotFound):
        catalog.get("x")


def test_b4_b6_flatten(spark):
    df = spark.sql("""select 1 id, parse_json('{"a":{"b":[1,{"c":"x"},[2.5]]},"t":true,"n":null,"o":[{"k":"p"},{"k":"q"}]}') doc union all select 2, parse_json('["r", 3]')""")
    rows = {(r.id, r.field, r.s, r.n, r.d) for r in flatten.variant_entries(df, "id", "doc").collect()}
    assert rows == {(1, "a$b", None, 1, None), (1, "a$b$c", "x", None, None), (1, "a$b", None, None, 2.5), (1, "o$k", "p", None, None), (1, "o$k", "q", None, None), (2, "value", "r", None, None), (2, "value", None, 3, None)}
    maps = flatten.regroup(flatten.variant_entries(df, "id", "doc")).filter("id = 1").first()
    assert maps.s["o$k"] == ["p", "q"] and maps.n["a$b"] == [1]
    assert flatten.entries(spark.range(2), "id").count() == 0


def test_a17_a19_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(" s ,p,r,c,h, name ,1.5,2,x,7.9,2012,3\n")
    row = csvload.prescriptions(spark, str(path)).first()
    assert row["sha"] == "s" and row["bnf-name"] == "name" and row["items"] == 1.5 and row["act-cost"] is None and row["quantity"] == 7 and row["year"] == 2012
    gp = tmp_path / "gp.csv"
    gp.write_text(",".join(f" {i} " for i in range(20)) + "\n")
    row = csvload.practices(spark, str(gp)).first()
    assert len(row) == 20 and row["organisation-code"] == "0" and row["practice-type"] == "19"
    db = Database(spark)
    assert csvload.load(db, csvload.practices(spark, str(gp)).select("postcode").unionByName(spark.sql("select 'x' postcode")), "gp", batch=1) == 2
    assert db.load_document("gp-1") == {"postcode": "9"} and db.store.newest() == 2
    ids = [r.id for r in csvload.with_sequential_ids(spark.range(0, 10, 1, 3).select(F.col("id").alias("v")), "docs").orderBy("v").collect()]
    assert ids == [f"docs-{i}" for i in range(1, 11)]


def test_e1_e2_rates(spark):
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(at, "a", 2), (at + dt.timedelta(seconds=1), "a", 4), (at + dt.timedelta(seconds=11), "b", 1)], "ts timestamp, event_type string, n int")
    assert {(r.event_type, r.total, r.rate) for r in rates.rates(events, amount="n", seconds=10).collect()} == {("a", 6, 0.6), ("b", 1, 0.1)}
    assert {tuple(r) for r in rates.totals(events, amount="n").collect()} == {("a", 6), ("b", 1)}


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
