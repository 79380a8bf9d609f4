"""The record engine: every registered query against DuckDB, and what SQL can't show."""

import duckdb
import pytest

import __spark_entry__ as entry
from cellstream.aio import AsyncStream
from cellstream.functions.expr import Always, define, identity, over
from cellstream.operators import collectors as C
from cellstream.operators.stream import RecordStream
from cellstream.operators.update import after, all_of, before, install, remove, write
from cellstream.plans import catalogue
from cellstream.plans.access import plan_of
from cellstream.sources.store import ConcurrentChange, Configuration, DatasetManager, Transaction, TransactionTimeout
from cellstream.streaming.changes import register_listener

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
X, Y, S = define("x", "int"), define("y", "double"), define("s", "string")


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, data, db, name):
    got = catalogue.QUERIES[name](spark, data)
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = [tuple(r[c] for c in order) for r in got.collect()]
    told = [tuple(dict(zip(want.columns, r, strict=True))[c] for c in order) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, told)) or sorted(rows, key=repr) == pytest.approx(sorted(told, key=repr))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def few(spark):
    return RecordStream(spark.createDataFrame([(1, 5, 1.5, "ab"), (2, None, None, None), (3, -7, float("nan"), "")], "k long, x int, y double, s string"), "k")


def test_absent_cells(few):
    def keys(p):
        return sorted(r.k for r in few.filter(p).to_array())

    assert keys(X.value().is_(5)) == [1] and keys(X.value().is_(5).negate()) == [3]
    assert keys((X.value().is_(5) & S.exists()).negate()) == [2, 3]
    assert keys(S.value().starts_with("a").negate()) == [2, 3]
    assert keys(X.exists().negate()) == [2] and keys(X.value_or(0).is_(0)) == [2]
    assert keys(Y.value().is_greater_than(1e300)) == [3]
    assert keys(Always()) == [1, 2, 3] and keys(Always().negate()) == []


def test_arithmetic_edges(spark, few):
    with pytest.raises(ZeroDivisionError):
        X.value().divide(0)
    assert [r[0] for r in few.frame().select(Y.value_or(2.0).divide(0.0).column()).collect()][:2] == [float("inf")] * 2
    assert X.value_or(0).add(1).kind == "int"
    with pytest.raises(OverflowError):
        X.value().is_(1 << 40)
    with pytest.raises(Exception, match="no cell x"):
        few.map(X.value_or_fail()).to_array()


def test_terminals_and_own_folds(few):
    ints = few.filter(X.exists()).map_to_int(X.value_or_fail())
    assert ints.sum() == -2 and ints.average() == -1.0 and ints.reduce(lambda a, b: a + b) == -2 and ints.reduce(lambda a, b: a + b, 0) == -2
    none = few.filter(X.value().is_(99)).map_to_int(X.value_or_fail())
    assert none.sum() == 0 and none.average() is None and none.max() is None and none.reduce(max) is None and none.find_any() is None
    assert ints.collect3(list, lambda box, v: box.append(v), lambda a, b: a.extend(b)).__len__() == 2
    assert few.collect(C.grouping_by(S.value_or("none"), C.counting())) == {"ab": 1, "none": 1, "": 1}
    assert few.collect(C.partitioning_by(X.exists())) == {True: 2, False: 1}
    assert few.sorted(X.value().as_comparator().reversed()).find_first().k == 1
    with pytest.raises(TypeError):
        few.sorted()
    closed = []
    with few.on_close(lambda: closed.append(1)) as s:
        assert s.count() == 3
    assert closed == [1]
    assert AsyncStream(few).filter(X.exists()).count().result() == 2


def test_plans():
    a, b = X.value().is_greater_than(5), X.value().is_less_than(0)
    assert plan_of(a & b, {"x": 3}).kind == "SKIP"
    assert plan_of(a | b, {"x": 3}).kind == "MULTI" and len(plan_of(a | b, {"x": 3}).ranges) == 2
    assert plan_of(a & X.value().is_less_than(9), {"x": 3}).kind == "SORTED_INDEX"
    assert plan_of(a | S.value().is_("q"), {"x": 3}).kind == "FULL"
    assert plan_of((a | b).negate(), {"x": 3}).kind == "FULL"  # absent cells match too
    assert plan_of(Always(), {"x": 1}).kind == "FULL"
    assert plan_of(a & S.value().is_("q"), {"x": 9, "s": 2}).cell == "s"


def test_datasets(spark, tmp_path):
    manager = DatasetManager(spark, str(tmp_path / "store"))
    assert manager.new("d", define("k", "long")) and not manager.new("d", define("k", "long"))
    d = manager.get("d", "long")
    assert d.add(1, X.cell(5), S.cell("a")) and not d.add(1, X.cell(6)) and d.add(2, X.cell(7)) and d.add(3, S.cell("c"))
    assert d.get(1).x == 5 and d.get(9) is None and d.on(1).iff(X.value().is_(6)).read() is None
    assert d.on(1).add(X.cell(0)).x == 5
    before, after = d.on(1).update(write(X).result_of(X.value_or_fail().increment()))
    assert (before.x, after.x) == (5, 6)
    assert d.on(2).iff(X.value().is_(0)).update(remove(X)) is None
    d.upsert(2, S.cell("new"))
    assert d.get(2).x is None and d.get(2).s == "new"
    d.create_index(X)
    s = d.records().filter(X.value().is_greater_than(5))
    assert s.plan().kind == "SORTED_INDEX" and [r.k for r in s.to_array()] == [1]
    assert d.records().filter(X.value().is_(1) & X.value().is_(2)).plan().kind == "SKIP"
    assert d.on(3).delete().s == "c" and d.records().count() == 2
    assert [(i.cell, i.status, i.records) for i in d.live_indexes()] == [("x", "LIVE", 1)]
    seen = []
    register_listener(d, lambda rows, n: seen.extend((r.key, r.type) for r in rows.collect()), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(seen) == sorted([("1", "ADDITION"), ("2", "ADDITION"), ("3", "ADDITION"), ("1", "MUTATION"), ("2", "MUTATION"), ("3", "DELETION")])
    t = Transaction(d=d)
    t.mutate("d", X.exists(), write(X).value(0))
    assert d.get(1).x == 6
    t.commit()
    assert d.get(1).x == 0
    late = Transaction(d=d)
    late.delete("d", Always())
    d.add(8, X.cell(1))
    with pytest.raises(ConcurrentChange):
        late.commit()
    d.retain(1)
    assert len(d.versions()) == 1 and d.records().count() == 3
    assert manager.destroy("d") and manager.list() == []


@pytest.fixture
def store(spark, tmp_path):
    return DatasetManager(spark, str(tmp_path / "store"))


def heard(d, folder):
    seen, gone = [], []
    register_listener(d, lambda rows, n: seen.extend(tuple(r) for r in rows.collect()), str(folder), once=True, missed=gone.extend).awaitTermination()
    return sorted(seen, key=lambda r: (r[2], r[0])), gone


def test_no_version_that_is_kept_loses_its_folders(spark, store):
    rows = spark.createDataFrame([(k, k % 7, None if k % 3 else f"s{k}") for k in range(50)], "k long, x int, s string")
    assert store.new("d", define("k", "long"), rows, Configuration(buckets=4, indexes=(X,)))
    d = store.get("d")
    d.create_index(S)
    d.retain(1)
    assert len(d.versions()) == 1 and d.records().count() == 50
    assert sorted(r.k for r in d.records().filter(X.value().is_(3)).to_array()) == [k for k in range(50) if k % 7 == 3]
    d.on(3).update(write(X).value(99))
    d.delete(X.value().is_(4))
    d.retain(1)
    s = d.records().filter(X.value().is_greater_than(5))
    assert s.plan().kind == "SORTED_INDEX" and sorted(r.k for r in s.to_array()) == sorted([3, *(k for k in range(50) if k % 7 == 6)])
    assert {n.split("-")[0] for n in d.files.names(d.path)} <= {"data", "index", "changes", "log"}
    named = d._folders(d.manifest()) | {"log"}
    assert set(d.files.names(d.path)) == named


def test_indexes_outlive_writes_and_have_statistics(spark, store):
    store.new("d", define("k", "long"), configuration=Configuration(buckets=2))
    d = store.get("d")
    assert d.index_status(X) == "POTENTIAL"
    d.create_index(X)
    assert d.index_status(X) == "LIVE"
    d.add(1, X.cell(5))
    d.add(2, X.cell(9), S.cell("q"))
    d.add(3, S.cell("without"))
    d.on(2).update(remove(X))
    d.upsert(4, X.cell(-1))
    view = d.index(X)
    assert view.statistics()["records"] == 2 and view.statistics()["bytes"] > 0
    assert view.first().k == 4 and view.last().k == 1 and view.higher(-1).k == 1 and view.lower(-1) is None and [r.k for r in view.get(5)] == [1]
    assert d.records().filter(X.value().is_less_than(0)).plan().kind == "SORTED_INDEX"
    assert view.dataset.accesses["x"] == 2 and d.stream_shapes()[0][1] >= 1
    d.destroy_index(X)
    assert d.indexes() == [] and d.records().filter(X.value().is_(5)).count() == 1
    with pytest.raises(KeyError):
        d.destroy_index(X)
    with pytest.raises(ValueError):
        d.create_index(define("b", "bytes"))


def test_a_write_touches_its_bucket_alone(spark, store):
    store.new("d", define("k", "long"), spark.range(200).withColumnRenamed("id", "k").selectExpr("k", "cast(k as int) as x"), Configuration(buckets=8))
    d = store.get("d")
    was = d.manifest()["parts"]
    d.on(17).update(write(X).value(-1))
    now = d.manifest()["parts"]
    assert len(was) == 8 and sum(was[b] != now[b] for b in was) == 1
    assert d.get(17).x == -1 and d.records().count() == 200
    assert d.mutate(X.value().is_greater_than(1000), write(X).value(0)) == 0 and d.manifest()["parts"] == now
    assert d.add_all(spark.createDataFrame([(5, 0), (500, 1), (500, 1), (501, 2)], "k long, x int")) == 2 and d.records().count() == 202


def test_change_feed_sees_every_commit(spark, store, tmp_path):
    store.new("d", define("k", "long"))
    d = store.get("d")
    d.add(1, X.cell(1))
    with Transaction(d=d) as t:
        t.mutate("d", X.exists(), write(X).value(2))
        assert t.add("d", 2, X.cell(5)) and not t.add("d", 2, X.cell(6))
        t.mutate("d", X.value().is_(5), write(X).value(7))
        assert t.add("d", 3) and t.records("d").count() == 3
        t.delete("d", X.exists().negate())
    seen, gone = heard(d, tmp_path / "a")
    assert seen == [("1", "ADDITION", 2), ("1", "MUTATION", 3), ("2", "ADDITION", 3)] and gone == []
    assert [(r.k, r.x) for r in d.records().sorted(X.value().as_comparator()).to_array()] == [(1, 2), (2, 7)]
    d.delete(X.value().is_(7))
    assert heard(d, tmp_path / "a")[0] == [("2", "DELETION", 4)]
    with pytest.raises(ZeroDivisionError), Transaction(d=d) as t:
        t.delete("d", Always())
        raise ZeroDivisionError
    assert d.records().count() == 1
    late = Transaction(timeout=0.0, d=d)
    late.delete("d", Always())
    with pytest.raises(TransactionTimeout):
        late.commit()
    with pytest.raises(ConcurrentChange):
        base = d.manifest()
        d.upsert(9, X.cell(1))
        d.commit(d.frame(told=base), [], None, base)
    assert sorted(r.k for r in d.records().to_array()) == [1, 9]
    d.retain(1)
    assert d.records().count() == 2


def test_compare_and_set(store):
    store.new("d", define("k", "long"))
    d = store.get("d")
    d.add(1, X.cell(1), S.cell("a"))
    read = d.get(1)
    assert d.on(1).update_if_same(read, write(X).value(2))[1].x == 2
    assert d.on(1).update_if_same(read, write(X).value(3)) is None and d.get(1).x == 2
    assert d.on(1).iff(X.value().is_(3)).delete() is None and d.on(1).iff(X.value().is_(2)).delete().x == 2
    assert d.on(1).delete() is None


def test_one_name_in_two_types(spark, store):
    name, number = define("bar", "string"), define("bar", "int")
    store.new("d", define("k", "string"))
    d = store.get("d")
    d.add("a", name.cell("seven"))
    d.add("b", number.cell(7))
    d.add("c", number.cell(8), Y.cell(1.0))
    assert sorted(d.frame().columns) == ["bar", "bar#int", "k", "y"]

    def keys(p):
        return sorted(r.k for r in d.records().filter(p).to_array())

    assert keys(name.exists()) == ["a"] and keys(number.exists()) == ["b", "c"] and keys(number.value().is_(7)) == ["b"] and keys(name.value().starts_with("s")) == ["a"]
    assert keys(define("bar", "double").exists()) == [] and keys(define("nowhere", "long").exists().negate()) == ["a", "b", "c"]
    assert keys(define("y", "int").exists()) == []  # a double isn't cut to an int
    before_, after_ = d.on("a").update(write(number).value(1))
    assert (before_["bar"], after_["bar"], after_["bar#int"]) == ("seven", None, 1)
    d.mutate(number.value().is_(8), all_of(write(number).value(0), write(name).value("eight")))
    assert (d.get("c")["bar"], d.get("c")["bar#int"]) == ("eight", None)
    with pytest.raises(ValueError):
        d.add("d", name.cell("x"), number.cell(1))
    with pytest.raises(ValueError):
        install(name.cell("x"), number.cell(1))
    d.create_index(number)
    assert sorted(r.k for r in d.records().filter(number.value().is_less_than(5)).to_array()) == ["a"]
    total = d.records().filter(number.exists()).map_to_int(number.value_or_fail()).sum()
    assert total == 8


def test_collectors_compose_freely(spark):
    s = RecordStream(spark.createDataFrame([(1, 5, 1.0, "a"), (2, 5, 2.0, "a"), (3, 6, 3.0, "b"), (4, 7, 4.0, "b"), (5, 6, 5.0, "b")], "k long, x int, y double, s string"), "k")
    big, six = X.value().is_greater_than(5), X.value().is_(6)
    by_s, by_x = S.value(), X.value()
    assert s.collect(C.grouping_by(by_s, C.grouping_by(by_x))) == {"a": {5: 2}, "b": {6: 2, 7: 1}}
    assert s.collect(C.grouping_by(by_s, C.partitioning_by(six))) == {"a": {False: 2, True: 0}, "b": {False: 1, True: 2}}
    assert s.collect(C.partitioning_by(big, C.grouping_by(by_s))) == {False: {"a": 2}, True: {"b": 3}}
    assert s.collect(C.partitioning_by(X.value().is_(99), C.grouping_by(by_s, C.counting()))) == {False: {"a": 2, "b": 3}, True: {}}
    assert s.collect(C.filtering(big, C.grouping_by(by_s))) == {"b": 3}
    assert s.collect(C.grouping_by(by_s, C.filtering(big, C.counting()))) == {"a": 0, "b": 3}
    assert s.collect(C.grouping_by(by_s, C.filtering(big, C.grouping_by(by_x)))) == {"a": {}, "b": {6: 2, 7: 1}}
    sums = C.mapping(Y.value_or(0.0), C.summing)
    assert s.collect(C.composite(C.counting(), C.grouping_by(by_s, sums), C.filtering(six, sums), C.partitioning_by(six, sums))) == [5, {"a": 3.0, "b": 12.0}, 8.0, {False: 7.0, True: 8.0}]
    assert s.collect(C.grouping_by(by_s, C.composite(C.counting(), C.grouping_by(by_x, C.partitioning_by(six))))) == {
        "a": [2, {5: {False: 2, True: 0}}],
        "b": [3, {6: {False: 0, True: 2}, 7: {False: 1, True: 0}}],
    }
    assert s.collect(C.partitioning_by(six, C.partitioning_by(big))) == {False: {False: 2, True: 1}, True: {False: 0, True: 2}}
    none = s.filter(X.value().is_(99))
    assert none.collect(C.grouping_by(by_s, C.grouping_by(by_x))) == {} and none.collect(C.partitioning_by(six, C.averaging(Y.value()))) == {False: 0.0, True: 0.0}
    rows = s.collect_frame(C.grouping_by(by_s, C.grouping_by(by_x))).collect()
    assert sorted(map(tuple, rows)) == [("a", 5, 2), ("b", 6, 2), ("b", 7, 1)] and rows[0].asDict().keys() == {"key", "key_2", "count"}
    with pytest.raises(ValueError):
        s.collect_frame(C.composite(C.counting(), C.grouping_by(by_s)))
    with pytest.raises(ValueError):
        s.collect_frame(C.composite(C.counting(), C.counting()))


def test_long_numbers_wrap_around(spark):
    top = (1 << 63) - 1
    v = define("v", "long")
    values = [0, 1, -1, top, -top - 1, 123456789012345]
    df = spark.createDataFrame([(x,) for x in values], "v long")

    def wrapped(x):
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    for n in (1, -1, top, -top - 1, 1 << 40, -(1 << 33) - 7):
        e = v.value_or(0)
        with over(df):
            got = df.select("v", e.add(n, wrap=True).column(), e.subtract(n, wrap=True).column(), e.multiply(n, wrap=True).column()).collect()
        for r in got:
            assert tuple(r)[1:] == (wrapped(r.v + n), wrapped(r.v - n), wrapped(r.v * n)), (r.v, n)


def test_pairs_logs_and_self_closing(few, caplog):
    pairs = few.filter(X.exists()).mutate_then(write(X).result_of(X.value_or_fail().add(1)))
    got = pairs.select(before(X.value_or_fail().multiply(2)).column().alias("b"), after(X.value_or(0).add(10)).column().alias("a"), before("s", "string").column().alias("s")).collect()
    assert sorted(map(tuple, got)) == [(-14, 4, ""), (10, 16, "ab")]
    assert few.log("k=%s", X.value()).count() == 3
    closed = []
    s = few.on_close(lambda: closed.append(1)).self_close()
    assert s.filter(X.exists()).map(X.value()).count() == 2 and closed == [1]
    assert few.map(identity()).count() == 3
    assert write("n", 5).columns({}, "k").keys() == {"n"}


def test_plans_are_told(few):
    told = []
    few.filter(X.value().is_(5)).explain(told.append, physical=True)
    assert told[0].kind == "FULL" and "Physical Plan" in told[1]


def test_writes_that_try_once(store):
    store.new("d", define("k", "long"))
    d = store.get("d")
    once, old = d.trying(), d.manifest()
    d.add(1, X.cell(1))
    once.manifest = lambda version=None: old
    with pytest.raises(ConcurrentChange):
        once.add(2, X.cell(2))
    assert d.records().count() == 1 and d.add(2, X.cell(2))


def test_configurations():
    made = Configuration.from_xml('<dataset buckets="4" durability="TIMED" durability-millis="50"><index name="x" type="INT"/></dataset>')
    assert made == Configuration.from_json('{"buckets": 4, "durability": "TIMED", "durability_millis": 50, "indexes": [{"name": "x", "type": "int"}]}')
    assert made.indexes == (X,)
    assert Configuration(durability="TIMED", durability_millis=100).told()["durability_millis"] == 100
    for bad in ({"durability": "TIMED"}, {"durability": "SOMETIMES"}, {"buckets": 0}):
        with pytest.raises(ValueError):
            Configuration(**bad)


def test_filters_reach_the_scan(spark, data):
    plan = catalogue.returned_revenue(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_tax" not in plan


def test_equal_extremes_of_groups_are_those_of_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, which of equal rows arg_max takes may vary
    few = "('5', 'A'), ('-3', 'A'), (NULL, 'A'), ('0', 'B'), ('-0.0', 'B'), ('NaN', 'C'), ('1', 'C'), (NULL, 'D'), ('7', NULL)"
    rows = f"SELECT CAST(b AS DOUBLE) AS c_acctbal, s AS c_mktsegment FROM (VALUES {few}) t(b, s), range(3)"
    con.sql(f"CREATE TABLE customer AS SELECT row_number() OVER () AS c_custkey, * FROM ({rows}) ORDER BY c_custkey")
    want = {r[0]: r[1:] for r in con.sql(catalogue.ORACLE_SQL["extremes_by_group"]).fetchall()}
    for way in ("ASC", "DESC"):
        (tmp_path / way).mkdir()
        con.sql(f"COPY (SELECT * FROM customer ORDER BY c_custkey {way}) TO '{tmp_path}/{way}/customer.parquet'")
        assert {r.key: (r.top, r.low) for r in catalogue.extremes_by_group(spark, f"{tmp_path}/{way}").collect()} == want


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("boolean", [True, None, False]),
        ("int", [3, -(1 << 31), None, (1 << 31) - 1]),
        ("long", [3, -(1 << 63), None, (1 << 63) - 1]),
        ("double", [float("nan"), 0.0, None, float("-inf"), float("inf"), -2.5]),
        ("string", ["ab", "", None, "a", "é", "a\0", "\U0001f600"]),
    ],
)
def test_ties_of_extremes_are_taken_as_sorted(spark, kind, values):
    cell = define("t", {"boolean": "bool"}.get(kind, kind)).value().as_comparator()
    df = spark.createDataFrame(list(enumerate(values)), f"k long, t {kind}")
    for tie in (cell, cell.reversed()):
        keys = [r.k for r in RecordStream(df, "k").sorted(tie).to_array()]
        # group n lacks the first n records of the sort
        rows = [(n, k, 1, values[k]) for n in range(len(keys)) for k in keys[n:]]
        s, by = RecordStream(spark.createDataFrame(rows, f"n int, k long, x int, t {kind}"), "k"), X.value().as_comparator()
        down = C.composite(C.max_by(by, ties=(tie,)), C.min_by(by, ties=(tie,)), C.max_by(by.reversed(), "last", (tie,)))
        found = s.collect_frame(C.grouping_by(define("n", "int").value(), down)).collect()
        assert {r.key: {r["max"].k, r["min"].k, r["last"].k} for r in found} == {n: {k} for n, k in enumerate(keys)}
