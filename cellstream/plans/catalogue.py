"""Registered queries of the record engine, with their SQL. Each names the operators it shows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstream.functions.expr import Always, Opaque, constant, define, identity, key, over, same_record, untyped
from cellstream.operators import collectors as C
from cellstream.operators.stream import RecordStream, ValueStream, mutated, without
from cellstream.operators.update import after, all_of, before, custom, install, remove, write
from cellstream.sources.store import Configuration, Dataset, DatasetManager, Transaction

FLAG, STATUS = define("l_returnflag", "string"), define("l_linestatus", "string")
PRICE, QUANTITY, DISCOUNT = define("l_extendedprice", "double"), define("l_quantity", "double"), define("l_discount", "double")
LINE = define("l_linenumber", "int")
SIZE, TYPE, NAME, RETAIL = define("p_size", "int"), define("p_type", "string"), define("p_name", "string"), define("p_retailprice", "double")
TOTAL, PRIORITY, ORDER_STATUS, CUSTOMER = define("o_totalprice", "double"), define("o_orderpriority", "string"), define("o_orderstatus", "string"), define("o_custkey", "long")
ORDER_KEY = define("o_orderkey", "long")
QUALITY, TOXIC = define("quality", "int"), define("toxic", "int")
SEGMENT, BALANCE = define("c_mktsegment", "string"), define("c_acctbal", "double")
REGION = define("n_regionkey", "int")
PART = define("p_partkey", "long")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def records(spark: SparkSession, sf_dir: str, table: str, key: str) -> RecordStream:
    return RecordStream(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)


def one(spark: SparkSession, types: str, *values: Any) -> DataFrame:
    """What terminal operations gave, as a row."""
    return spark.createDataFrame([values], types)


def manager(spark: SparkSession) -> DatasetManager:
    """Datasets in a new folder that the driver and all executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return DatasetManager(spark, f"{shared or tempfile.mkdtemp(prefix='cellstream-')}/store-{uuid.uuid4().hex}")


def stored(spark: SparkSession, sf_dir: str, *indexes) -> Dataset:
    """Parts as a dataset on disk."""
    found = manager(spark)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    found.new("parts", PART, rows, Configuration(buckets=4, indexes=indexes))
    return found.get("parts", "long")


def lines(spark, d):
    return records(spark, d, "lineitem", "l_orderkey")


def parts(spark, d):
    return records(spark, d, "part", "p_partkey")


def orders(spark, d):
    return records(spark, d, "orders", "o_orderkey")


def labelled(spark, d) -> RecordStream:
    """Documents with the cells of their label, which many lack."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return RecordStream(docs.join(labels, "doc_id", "left"), "doc_id")


_LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"


def register(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@register("SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS total FROM lineitem WHERE l_returnflag = 'R'")
def returned_revenue(spark, d):
    s = lines(spark, d).filter(FLAG.value().is_("R")).map_to_double(PRICE.value_or_fail())
    return s.sum_frame().select(F.round("sum", 2).alias("total"))


# ---- predicates


@register("SELECT count(*) AS n FROM part WHERE p_size > 10 AND p_size <= 30 AND (p_type LIKE 'S%' OR p_size >= 25) AND NOT p_size = 12")
def comparisons(spark, d):
    p = SIZE.value().is_greater_than(10) & SIZE.value().is_less_than_or_equal_to(30)
    p = p & (TYPE.value().starts_with("S") | SIZE.value().is_greater_than_or_equal_to(25)) & SIZE.value().is_(12).negate()
    return parts(spark, d).filter(p).collect_frame(C.counting("n"))


@register(f"SELECT doc_id FROM {_LABELLED} WHERE coalesce(toxic <> 1, false)")
def gated_negation(spark, d):
    return labelled(spark, d).filter(TOXIC.value().is_(1).negate()).frame().select("doc_id")


@register(f"SELECT doc_id FROM {_LABELLED} WHERE NOT (coalesce(toxic = 1, false) AND coalesce(quality = 1, false))")
def ungated_negation(spark, d):
    return labelled(spark, d).filter((TOXIC.value().is_(1) & QUALITY.value().is_(1)).negate()).frame().select("doc_id")


@register(f"SELECT count(*) FILTER (WHERE quality IS NOT NULL) AS present, count(*) FILTER (WHERE quality IS NULL) AS absent FROM {_LABELLED}")
def exists_and_negation(spark, d):
    return labelled(spark, d).collect_frame(C.composite(C.filtering(QUALITY.exists(), C.counting("present")), C.filtering(QUALITY.exists().negate(), C.counting("absent"))))


@register(f"SELECT doc_id, coalesce(quality, -1) AS value, coalesce(quality, -1) > 0 AS good FROM {_LABELLED}")
def value_or(spark, d):
    q = QUALITY.value_or(-1)
    return labelled(spark, d).frame().select("doc_id", q.column().alias("value"), q.is_greater_than(0).column().alias("good"))


@register("SELECT any_match, all_match, none_match FROM (SELECT bool_or(p_size > 49) AS any_match, bool_and(p_size > 0) AS x, bool_and(p_size > 49) AS all_match, NOT bool_or(p_size > 49) AS none_match FROM part)")
def matches(spark, d):
    return parts(spark, d).match_frame(SIZE.value().is_greater_than(49))


@register("SELECT false AS any_match, true AS all_match, true AS none_match")
def matches_of_nothing(spark, d):
    return parts(spark, d).filter(SIZE.value().is_less_than(-5)).match_frame(SIZE.value().is_(1))


# ---- projections


@register("SELECT p_partkey, p_size + 3 AS added, p_size - 3 AS less, p_size * 2 AS doubled, CAST(trunc((p_size - 20) / 7) AS INTEGER) AS divided, p_retailprice / 4 AS quarter FROM part")
def arithmetic(spark, d):
    s = SIZE.value_or(0)
    out = {"added": s.add(3), "less": s.subtract(3), "doubled": s.multiply(2), "divided": s.subtract(20).divide(7), "quarter": RETAIL.value_or(0.0).divide(4)}
    return parts(spark, d).frame().select("p_partkey", *(e.column().alias(k) for k, e in out.items()))


@register("SELECT p_partkey, CAST(((CAST(p_size AS BIGINT) + 2147483640 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS wrapped FROM part")
def wrapping_addition(spark, d):
    return parts(spark, d).frame().select("p_partkey", SIZE.value_or(0).add(2147483640, wrap=True).column().alias("wrapped"))


@register("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, starts_with(p_type, 'S') AS s FROM part")
def strings(spark, d):
    return parts(spark, d).frame().select("p_partkey", NAME.value().length().column().alias("n"), TYPE.value().starts_with("S").column().alias("s"))


@register("SELECT DISTINCT CAST(p_size AS BIGINT) * 2 AS value FROM part WHERE p_size * 2 > 20")
def value_stream(spark, d):
    s = parts(spark, d).map_to_int(SIZE.value_or_fail()).as_long_stream().map(lambda v: v.multiply(2)).filter(lambda v: v.is_greater_than(20))
    return s.distinct().frame()


@register("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def flat_map(spark, d):
    s = parts(spark, d).flat_map(F.split("p_name", " "), "string")
    return s.collect_frame(C.grouping_by(s.value, C.counting("n"), "value"))


@register("SELECT CAST(p_size AS DOUBLE) AS value FROM part")
def as_double(spark, d):
    return parts(spark, d).map_to_int(SIZE.value_or_fail()).as_double_stream().frame()


# ---- order


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sorted_limit(spark, d):
    s = orders(spark, d).sorted(TOTAL.value().as_comparator().reversed(), ORDER_KEY.value().as_comparator()).limit(10)
    return s.frame().select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r > 5 AND r <= 15")
def skip_then_limit(spark, d):
    s = orders(spark, d).sorted(ORDER_KEY.value().as_comparator()).sorted(TOTAL.value().as_comparator()).skip(5).limit(10)
    return s.frame().select("o_orderkey")


@register("SELECT max(p_size) AS max, min(p_size) AS min, CAST(max(p_size) AS BIGINT) * 2 AS long_max, min(p_retailprice) AS double_min FROM part")
def extremes(spark, d):
    sizes = parts(spark, d).map_to_int(SIZE.value_or_fail())
    prices = parts(spark, d).map_to_double(RETAIL.value_or_fail())
    longs = sizes.as_long_stream().map(lambda v: v.multiply(2))
    return one(spark, "max int, min int, long_max bigint, double_min double", sizes.max(), sizes.min(), longs.max(), prices.min())


@register("SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS dearest, true AS found, true AS nothing FROM orders")
def found_records(spark, d):
    s, by_key = orders(spark, d), ORDER_KEY.value().as_comparator()
    dearest = s.sorted(TOTAL.value().as_comparator().reversed(), by_key).find_first()
    none = s.filter(TOTAL.value().is_less_than(-1.0))
    return one(
        spark, "first bigint, last bigint, dearest bigint, found boolean, nothing boolean",
        s.min(by_key).o_orderkey, s.max(by_key).o_orderkey, dearest.o_orderkey, s.find_any() is not None, none.find_any() is None and none.min(by_key) is None,
    )


@register("SELECT p_size AS value FROM part ORDER BY p_size LIMIT 12")
def natural_order(spark, d):
    return parts(spark, d).map_to_int(SIZE.value_or_fail()).sorted().limit(12).frame()


# ---- terminals and collectors

_SUM = "count({0}) AS {1}_count, round(coalesce(sum({0}), 0), 2) AS {1}_sum, min({0}) AS {1}_min, max({0}) AS {1}_max, round(avg({0}), 6) AS {1}_avg"


def _rounded(df: DataFrame, two: tuple[str, ...] = (), six: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({**{c: F.round(c, 2) for c in two}, **{c: F.round(c, 6) for c in six}})


@register(f"SELECT {_SUM.format('l_quantity', 'value')} FROM lineitem")
def summary_statistics(spark, d):
    return _rounded(lines(spark, d).map_to_double(QUANTITY.value_or_fail()).summary_frame(), ("value_sum",), ("value_avg",))


@register("SELECT CAST(0 AS BIGINT) AS value_count, CAST(0 AS BIGINT) AS value_sum, 2147483647 AS value_min, -2147483648 AS value_max, CAST(0.0 AS DOUBLE) AS value_avg")
def summary_of_nothing(spark, d):
    return lines(spark, d).filter(LINE.value().is_less_than(0)).map_to_int(LINE.value_or_fail()).summary_frame()


@register("SELECT round(avg(l_discount), 6) AS average FROM lineitem WHERE l_linenumber = 2")
def average(spark, d):
    return _rounded(lines(spark, d).filter(LINE.value().is_(2)).map_to_double(DISCOUNT.value_or_fail()).average_frame(), six=("average",))


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
def nested_grouping(spark, d):
    down = C.composite(C.counting("n"), C.summing(PRICE.value_or_fail(), "total"), C.averaging(DISCOUNT.value_or_fail(), "discount"))
    made = C.grouping_by(FLAG.value(), C.grouping_by(STATUS.value(), down, "l_linestatus"), "l_returnflag")
    return _rounded(lines(spark, d).collect_frame(made), ("total",), ("discount",))


@register("SELECT b AS key, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM (VALUES (true), (false)) t(b) LEFT JOIN orders ON (o_totalprice > 1e12) = b GROUP BY b")
def partitioning_with_an_empty_side(spark, d):
    made = C.partitioning_by(TOTAL.value().is_greater_than(1e12), C.composite(C.counting("n"), C.summing(TOTAL.value_or_fail(), "total")))
    return _rounded(orders(spark, d).collect_frame(made), ("total",))


@register("SELECT o_orderstatus AS key, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, count(*) AS n FROM orders GROUP BY o_orderstatus")
def filtering(spark, d):
    dear = C.filtering(TOTAL.value().is_greater_than(200000.0), C.counting("dear"))
    return orders(spark, d).collect_frame(C.grouping_by(ORDER_STATUS.value(), C.composite(dear, C.counting("n"))))


@register("SELECT l_linenumber AS key, round(var_pop(l_quantity), 4) AS pop, round(var_samp(l_quantity), 4) AS samp FROM lineitem GROUP BY l_linenumber")
def variance(spark, d):
    down = C.composite(C.variance(QUANTITY.value(), "population", "pop"), C.variance(QUANTITY.value(), "sample", "samp"))
    return lines(spark, d).collect_frame(C.grouping_by(LINE.value(), down)).withColumns({c: F.round(c, 4) for c in ("pop", "samp")})


@register("SELECT c_mktsegment AS key, arg_max(c_custkey, c_acctbal) AS top, arg_min(c_custkey, c_acctbal) AS low FROM customer GROUP BY c_mktsegment")
def extremes_by_group(spark, d):
    """Of customers with equal balances the one with the smallest key, the first that SQL meets in a table by key."""
    by, ties = BALANCE.value().as_comparator(), (key("c_custkey", "long").as_comparator(),)
    made = C.grouping_by(SEGMENT.value(), C.composite(C.max_by(by, ties=ties), C.min_by(by, ties=ties)))
    df = records(spark, d, "customer", "c_custkey").collect_frame(made)
    return df.select("key", F.col("max.c_custkey").alias("top"), F.col("min.c_custkey").alias("low"))


@register("SELECT l_returnflag AS key, " + _SUM.format("l_quantity", "stats") + " FROM lineitem GROUP BY l_returnflag")
def summarizing(spark, d):
    return _rounded(lines(spark, d).collect_frame(C.grouping_by(FLAG.value(), C.summarizing(QUANTITY.value()))), ("stats_sum",), ("stats_avg",))


@register("SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def distinct_count(spark, d):
    return records(spark, d, "customer", "c_custkey").map(SEGMENT.value()).distinct().collect_frame(C.counting("n"))


# ---- mutation

_PART = "p_partkey, p_name, p_brand, p_type"


@register(f"SELECT {_PART}, CASE WHEN p_size > 20 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_size > 20 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")
def update_all_of(spark, d):
    op = all_of(write(SIZE).result_of(SIZE.value_or_fail().increment()), remove(RETAIL))
    return mutated(parts(spark, d).frame(), "p_partkey", SIZE.value().is_greater_than(20), op)


@register("SELECT p_partkey, p_size AS before, 7 AS after FROM part WHERE p_size < 5")
def mutate_then(spark, d):
    df = parts(spark, d).filter(SIZE.value().is_less_than(5)).mutate_then(write(SIZE).value(7))
    return df.select(F.col("first.p_partkey").alias("p_partkey"), F.col("first.p_size").alias("before"), F.col("second.p_size").alias("after"))


@register("SELECT p_partkey, CAST(NULL AS VARCHAR) AS p_name, 1 AS p_size FROM part WHERE p_size = 3")
def install_cells(spark, d):
    df = parts(spark, d).filter(SIZE.value().is_(3)).mutate_then(install(SIZE.cell(1)))
    return df.select(*(F.col(f"second.{c}").alias(c) for c in ("p_partkey", "p_name", "p_size")))


@register("SELECT p_partkey FROM part WHERE NOT (p_size > 25)")
def delete(spark, d):
    return without(parts(spark, d).frame(), SIZE.value().is_greater_than(25)).select("p_partkey")


@register("SELECT p_partkey FROM part WHERE p_size > 25")
def delete_then(spark, d):
    return parts(spark, d).filter(SIZE.value().is_greater_than(25)).delete_then().select("p_partkey")


@register("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup(spark, d):
    regions = spark.read.parquet(f"{d}/region.parquet")
    return records(spark, d, "nation", "n_nationkey").lookup(REGION.value(), regions, "r_regionkey").select("n_name", "r_name")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def lookup_without_match(spark, d):
    other = orders(spark, d).filter(TOTAL.value().is_greater_than(200000.0)).frame().select("o_custkey")
    return records(spark, d, "customer", "c_custkey").lookup(define("c_custkey", "long").value(), other, "o_custkey", "left_anti").select("c_custkey")


# ---- values by kind


@register(
    "SELECT p_partkey, p_partkey + 1 AS up, p_partkey - 1 AS down, p_partkey * 3 AS tripled, p_partkey // 7 AS part, CAST(5 AS BIGINT) AS five, CAST(p_retailprice AS DOUBLE) + 0.5 AS dearer, "
    "p_partkey - 9223372036854775807 + p_partkey AS x FROM part"
)
def long_arithmetic(spark, d):
    k, price = key("p_partkey", "long"), RETAIL.value_or(0.0)
    low = k.subtract((1 << 63) - 1, wrap=True).column() + k.column()
    columns = [k.increment(), k.decrement(), k.multiply(3), k.divide(7), constant(5, "long"), price.add(0.5)]
    return parts(spark, d).frame().select("p_partkey", *(e.column().alias(n) for e, n in zip(columns, ("up", "down", "tripled", "part", "five", "dearer"), strict=True)), low.alias("x"))


@register("SELECT (CAST(p_partkey AS HUGEINT) + 9223372036854775807 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 = w AS same, count(*) AS n FROM (SELECT p_partkey, p_partkey - 9223372036854775807 - 2 AS w FROM part WHERE p_partkey > 0) GROUP BY 1")
def long_wraps(spark, d):
    k = key("p_partkey", "long")
    df = parts(spark, d).filter(PART.value().is_greater_than(0)).frame().select((k.add((1 << 63) - 1, wrap=True).column() == k.column() - F.lit((1 << 63) - 1) - F.lit(2)).alias("same"))
    return df.groupBy("same").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) FILTER (WHERE dear) AS yes, count(*) FILTER (WHERE NOT dear) AS no, count(*) FILTER (WHERE p = '1-URGENT') AS urgent FROM (SELECT o_totalprice > 150000 AS dear, o_orderpriority AS p FROM orders)")
def truth_cells(spark, d):
    dear, s = define("dear", "bool"), orders(spark, d)
    s = RecordStream(s.frame().withColumn("dear", F.col("o_totalprice") > 150000), "o_orderkey")
    parts_ = ((dear.value().is_true(), "yes"), (dear.value().is_false(), "no"), (PRIORITY.value_or("").is_("1-URGENT"), "urgent"))
    return s.collect_frame(C.composite(*(C.filtering(p & Always(), C.counting(n)) for p, n in parts_)))


@register("SELECT value FROM (SELECT CAST(trunc(p_retailprice) AS INTEGER) * 2 AS value FROM part) WHERE value > 1900")
def double_to_int(spark, d):
    s = parts(spark, d).map_to_double(RETAIL.value_or_fail()).map_to("int").boxed().map(lambda v: v.multiply(2)).peek("passed")
    return s.filter(lambda v: v.is_greater_than(1900)).unordered().parallel().sequential().frame()


@register("SELECT CAST(p_partkey AS INTEGER) AS value FROM part WHERE p_partkey % 2 = 0")
def long_to_int(spark, d):
    s = parts(spark, d).map(key("p_partkey", "long")).map_to("int")
    return s.filter(Opaque(F.col("value") % 2 == 0)).batch(10).inline().frame()


@register("SELECT CAST(unnest([p_retailprice, p_retailprice / 2]) AS DOUBLE) AS value FROM part")
def double_flat_map(spark, d):
    s = parts(spark, d).map_to_double(RETAIL.value_or_fail())
    return s.flat_map(F.array(F.col("value"), F.col("value") / 2), "double").frame()


@register("SELECT bool_or(l_quantity > 49) AS any_match, bool_and(l_quantity > 49) AS all_match, NOT bool_or(l_quantity > 49) AS none_match FROM lineitem")
def double_matches(spark, d):
    s = lines(spark, d).map_to_double(QUANTITY.value_or_fail())
    p = s.value.is_greater_than(49.0)
    return one(spark, "any_match boolean, all_match boolean, none_match boolean", s.any_match(p), s.all_match(p), s.none_match(p))


@register("SELECT max(p_size) AS largest, CAST(sum(p_size) AS BIGINT) AS total, max(p_partkey) AS last, min(p_retailprice) AS cheapest, true AS nothing FROM part")
def reductions(spark, d):
    s = parts(spark, d)
    sizes, keys, prices = s.map_to_int(SIZE.value_or_fail()), s.map(key("p_partkey", "long")), s.map_to_double(RETAIL.value_or_fail())
    none = s.filter(SIZE.value().is_less_than(-1)).map_to_int(SIZE.value_or_fail())
    made = (sizes.reduce(max), sizes.reduce(lambda a, b: a + b, 0), keys.reduce(max), prices.reduce(min), none.reduce(max) is None)
    return one(spark, "largest int, total bigint, last bigint, cheapest double, nothing boolean", *made)


@register("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, count(*) FILTER (WHERE p_size > 25) AS large, count(*) AS seen, count(*) AS walked, count(*) AS passed FROM part")
def own_collections(spark, d):
    s = parts(spark, d).map_to_int(SIZE.value_or_fail())

    def add(box, v):
        box[0] += 1
        box[1] += v

    def join(a, b):
        a[0] += b[0]
        a[1] += b[1]

    n, total = s.collect3(lambda: [0, 0], add, join)
    seen, walked = spark.sparkContext.accumulator(0), []
    s.for_each(lambda v: seen.add(1))
    s.for_each_ordered(walked.append)
    large = s.filter(lambda v: v.is_greater_than(25)).to_array()
    return one(spark, "n bigint, total bigint, large bigint, seen bigint, walked bigint, passed bigint", n, total, len(large), seen.value, len(walked), sum(1 for _ in s.iterator()))


@register("SELECT n_name FROM nation WHERE n_nationkey = 3")
def record_equality(spark, d):
    s = records(spark, d, "nation", "n_nationkey")
    own = s.filter(define("n_nationkey", "int").value().is_(3)).find_first()
    return s.filter(same_record(own)).frame().select("n_name")


@register("SELECT count(*) AS n FROM nation")
def identities(spark, d):
    s = records(spark, d, "nation", "n_nationkey").map(identity())
    return s.distinct().collect_frame(C.counting("n"))


# ---- collectors within collectors


@register(
    "SELECT l_returnflag AS key, b AS key_2, count(*) FILTER (WHERE (l_quantity > 49.5) = b) AS count FROM lineitem CROSS JOIN (VALUES (true), (false)) t(b) GROUP BY 1, 2"
)
def grouping_of_partitions(spark, d):
    return lines(spark, d).collect_frame(C.grouping_by(FLAG.value(), C.partitioning_by(QUANTITY.value().is_greater_than(49.5))))


@register("SELECT l_linestatus AS key, l_returnflag AS key_2, count(*) AS count FROM lineitem WHERE l_quantity > 20 AND l_returnflag <> 'N' GROUP BY 1, 2")
def filtering_of_groups(spark, d):
    few = FLAG.value().is_("N").negate()
    made = C.filtering(QUANTITY.value().is_greater_than(20.0), C.grouping_by(STATUS.value(), C.filtering(few, C.grouping_by(FLAG.value()))))
    return lines(spark, d).collect_frame(made)


@register("SELECT o_totalprice > 150000 AS key, o_orderstatus AS key_2, count(*) AS count FROM orders GROUP BY 1, 2")
def partition_of_groups(spark, d):
    return orders(spark, d).collect_frame(C.partitioning_by(TOTAL.value().is_greater_than(150000.0), C.grouping_by_concurrent(ORDER_STATUS.value())))


@register("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def collected_values(spark, d):
    """Groups beside other collectors under a group, collected to a value."""
    down = C.composite(C.counting(), C.partitioning_by(TOTAL.value().is_greater_than(200000.0)), C.grouping_by(PRIORITY.value()))
    found = orders(spark, d).collect(C.grouping_by(ORDER_STATUS.value(), down))
    return spark.createDataFrame([(k, n, halves[True], len(groups)) for k, (n, halves, groups) in found.items()], "status string, n bigint, dear bigint, priorities bigint")


# ---- datasets on disk


@register("SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def stored_scan(spark, d):
    return stored(spark, d).records().frame()


@register(
    "SELECT p_partkey, CASE p_partkey WHEN 3 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey = 3 THEN NULL WHEN p_partkey = 5 THEN p_size + 1 WHEN p_size > 45 THEN 0 ELSE p_size END AS p_size "
    "FROM part WHERE p_partkey <> 7 AND (p_partkey IN (3, 5) OR NOT p_size = 1) UNION ALL SELECT 1000000000, 'added', 9"
)
def stored_writes(spark, d):
    """Adds, replaces, updates, deletes; each is a commit, and the last version is read back."""
    data = stored(spark, d, SIZE)
    data.add(1_000_000_000, NAME.cell("added"), SIZE.cell(9))
    data.add(3, NAME.cell("there already"))
    data.delete(SIZE.value().is_(1))
    data.mutate(SIZE.value().is_greater_than(45), write(SIZE).value(0))
    name, size = spark.read.parquet(f"{d}/part.parquet").where("p_partkey = 5").select("p_name", "p_size").first()
    data.upsert(5, NAME.cell(name), SIZE.cell(size))
    data.on(5).iff(SIZE.value().is_(size)).update(write(SIZE).result_of(SIZE.value_or_fail().increment()))
    data.on(5).iff(SIZE.value().is_(-1)).update(remove(SIZE))
    data.upsert(3, NAME.cell("new"))
    data.on(7).delete()
    return data.records().frame().select("p_partkey", "p_name", "p_size")


@register("SELECT 'SORTED_INDEX' AS plan, p_partkey FROM part WHERE p_size > 10 AND p_size <= 20")
def index_range_scan(spark, d):
    s = stored(spark, d, SIZE).records().filter(SIZE.value().is_greater_than(10)).filter(SIZE.value().is_less_than_or_equal_to(20))
    return s.frame().select(F.lit(s.plan().kind).alias("plan"), "p_partkey")


@register("SELECT 'MULTI' AS plan, p_partkey FROM part WHERE p_size < 5 OR p_size >= 48")
def index_ranges_scan(spark, d):
    s = stored(spark, d, SIZE).records().filter(SIZE.value().is_less_than(5) | SIZE.value().is_greater_than_or_equal_to(48))
    return s.frame().select(F.lit(s.plan().kind).alias("plan"), "p_partkey")


@register("SELECT 'SKIP' AS plan, CAST(0 AS BIGINT) AS n")
def skip_scan(spark, d):
    """A filter that contradicts itself reads nothing."""
    s = stored(spark, d).records().filter(SIZE.value().is_greater_than(30)).filter(SIZE.value().is_less_than(10))
    return one(spark, "plan string, n bigint", s.plan().kind, s.count())


@register(
    "SELECT count(*) AS records, (SELECT min(p_size) FROM part) AS first, (SELECT max(p_size) FROM part) AS last, (SELECT min(p_size) FROM part WHERE p_size > 20) AS higher, "
    "(SELECT max(p_size) FROM part WHERE p_size < 20) AS lower, (SELECT count(*) FROM part WHERE p_size = 20) AS held, 'LIVE' AS status FROM part"
)
def index_statistics(spark, d):
    data = stored(spark, d, SIZE)
    view = data.index(SIZE)
    made = (view.statistics()["records"], view.first().p_size, view.last().p_size, view.higher(20).p_size, view.lower(20).p_size, len(view.get(20)), data.index_status(SIZE))
    return one(spark, "records bigint, first int, last int, higher int, lower int, held bigint, status string", *made)


@register("SELECT p_partkey, p_size FROM part WHERE p_partkey = 17 AND p_size > 0")
def conditional_read(spark, d):
    row = stored(spark, d).on(17).iff(SIZE.value().is_greater_than(0)).read("p_partkey", "p_size")
    return one(spark, "p_partkey bigint, p_size int", *row)


@register("SELECT CAST(p_partkey AS VARCHAR) AS key, 'MUTATION' AS type FROM part WHERE p_size > 40 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'DELETION' FROM part WHERE p_size < 3")
def change_rows(spark, d):
    data = stored(spark, d)
    with Transaction(timeout=600.0, parts=data) as t:
        t.mutate("parts", SIZE.value().is_greater_than(40), custom(lambda kinds: {"p_retailprice": F.lit(1.0)}))
        t.delete("parts", SIZE.value().is_less_than(3))
    return spark.read.parquet(f"{data.path}/{data.manifest()['changes']}")


@register("SELECT p_partkey, p_size, NULL AS text, CAST(p_size AS VARCHAR) AS any FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, NULL, 'large', 'large' FROM part WHERE p_size > 10")
def cells_of_two_types(spark, d):
    """One name in two types: a cell of another type is absent, and writing one replaces the other."""
    text = define("p_size", "string")
    data = stored(spark, d)
    data.mutate(SIZE.value().is_greater_than(10), write(text).value("large"))
    df = data.records().frame()
    with over(df):
        return df.select("p_partkey", SIZE.value().column().alias("p_size"), text.value().column().alias("text"), untyped("p_size", df.columns).alias("any"))


@register("SELECT p_size AS was, p_size + 11 AS now, p_partkey AS key FROM part WHERE p_size < 9")
def before_and_after(spark, d):
    s = parts(spark, d).filter(SIZE.value().is_less_than(9))
    pairs = s.mutate_then(write(SIZE).result_of(SIZE.value_or_fail().increment()))
    now = after(SIZE.value_or(0).add(10)).column()
    return pairs.select(before("p_size", "int").column().alias("was"), now.alias("now"), before(key("p_partkey", "long")).column().alias("key"))
