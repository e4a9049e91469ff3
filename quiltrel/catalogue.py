"""The registered queries of the relational engine and their SQL.

Every query reads whole tables through a relation. Doubles enter by the lossy door as DECIMAL(12,2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltrel.functions import semiring as S
from quiltrel.operators import algebra as A
from quiltrel.operators.relation import Rel
from quiltrel.plans import captures, compare
from quiltrel.plans.builds import Store, transform
from quiltrel.shipping import ship
from quiltrel.sources.ingest import citations, ingest, lineage, lowered, source_rows
from quiltrel.streaming import delta as D
from quiltrel.streaming.nodes import DeltaNode, Maintained, Plan
from quiltrel.tables import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return lowered(spark.read.parquet(f"{d}/{name}.parquet").select(*cols))


#: Columns that no two rows of a table share.
KEYS = {
    "region": {"r_regionkey"}, "nation": {"n_nationkey"}, "customer": {"c_custkey"}, "supplier": {"s_suppkey"},
    "part": {"p_partkey"}, "orders": {"o_orderkey"}, "lineitem": {"l_orderkey", "l_linenumber"}, "events": {"event_id"},
}


def rel(spark: SparkSession, d: str, name: str, *cols: str, semiring: S.Semiring = S.Z) -> Rel:
    return Rel.of(table(spark, d, name, *cols), semiring, unique=KEYS[name] <= set(cols))


LI = ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
_N = "CAST(count(*) AS BIGINT)"


# -- select
@query("SELECT l_orderkey, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25")
def select_gt(spark, d):
    return rel(spark, d, "lineitem", *LI).select(F.col("l_quantity") > 25).to_bag()


@query("SELECT l_orderkey, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'N'")
def select_and(spark, d):
    return rel(spark, d, "lineitem", *LI).select((F.col("l_quantity") > 25) & (F.col("l_returnflag") != "N")).to_bag()


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE NOT (o_custkey < 500) OR o_orderstatus = 'F'")
def select_or_not(spark, d):
    return rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(~(F.col("o_custkey") < 500) | (F.col("o_orderstatus") == "F")).to_bag()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_text(spark, d):
    return rel(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.col("c_mktsegment") == "BUILDING").to_bag()


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey % 3 <> 0")
def select_udf(spark, d):
    ship(spark)
    return rel(spark, d, "supplier", "s_suppkey", "s_nationkey").select(lambda r: r["s_nationkey"] % 3 != 0).to_bag()


@query("SELECT 'select' AS operator, 'ZeroDivisionError' AS reason, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey = 0 HAVING count(*) > 0")
def select_udf_quarantine(spark, d):
    ship(spark)
    out = rel(spark, d, "nation", "n_nationkey", "n_regionkey").select(lambda r: 1 // r["n_regionkey"] >= 0)
    return out.quarantine().groupBy("operator", "reason").agg(F.sum("n").cast("long").alias("n"))


# -- project
@query("SELECT l_returnflag FROM lineitem")
def project_one(spark, d):
    return rel(spark, d, "lineitem", *LI).project(["l_returnflag"]).to_bag()


@query("SELECT o_orderstatus, o_orderpriority FROM orders")
def project_two(spark, d):
    return rel(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").project(["o_orderstatus", "o_orderpriority"]).to_bag()


@query(f"SELECT l_returnflag, l_linestatus, {_N} AS n FROM lineitem GROUP BY 1, 2")
def project_annotated(spark, d):
    return rel(spark, d, "lineitem", "l_returnflag", "l_linestatus").annotated()


# -- map
@query("SELECT o_custkey % 10 AS bucket, upper(o_orderstatus) AS status FROM orders")
def map_rows_expr(spark, d):
    return rel(spark, d, "orders", "o_custkey", "o_orderstatus").map_rows({"bucket": F.col("o_custkey") % 10, "status": F.upper("o_orderstatus")}).to_bag()


@query("SELECT CAST(10 // s_nationkey AS BIGINT) AS q FROM supplier WHERE s_nationkey <> 0")
def map_rows_udf(spark, d):
    ship(spark)
    return rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows(lambda r: {"q": 10 // r["s_nationkey"]}, "q long").to_bag()


@query("SELECT 'map_rows' AS operator, 'ZeroDivisionError' AS reason, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_nationkey = 0 HAVING count(*) > 0")
def map_rows_udf_quarantine(spark, d):
    ship(spark)
    out = rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows(lambda r: {"q": 10 // r["s_nationkey"]}, "q long")
    return out.quarantine().groupBy("operator", "reason").agg(F.sum("n").cast("long").alias("n"))


# -- union
@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")})
    return a.union(rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")})).to_bag()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey > 100")
def union_of_selects(spark, d):
    o = rel(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    return o.select(F.col("o_orderstatus") == "F").project(["o_orderkey"]).union(o.select(F.col("o_custkey") > 100).project(["o_orderkey"])).to_bag()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")})
    return a.union(rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")})).distinct().to_bag()


# -- join
def _orders(spark, d):
    return rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").map_rows({"custkey": F.col("o_custkey"), "o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus")})


def _customers(spark, d):
    return rel(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey").map_rows({"custkey": F.col("c_custkey"), "c_mktsegment": F.col("c_mktsegment"), "nationkey": F.col("c_nationkey")})


_OC = "orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT c_mktsegment, c_custkey AS custkey, c_nationkey AS nationkey, o_orderkey, o_orderstatus FROM {_OC}")
def join_using(spark, d):
    return _orders(spark, d).join(_customers(spark, d), ["custkey"]).to_bag()


@query(f"SELECT c_mktsegment, o_orderstatus FROM {_OC}")
def join_project(spark, d):
    return _orders(spark, d).join(_customers(spark, d), ["custkey"]).project(["c_mktsegment", "o_orderstatus"]).to_bag()


@query(f"SELECT DISTINCT c_mktsegment, o_orderstatus FROM {_OC}")
def join_distinct(spark, d):
    return _orders(spark, d).join(_customers(spark, d), ["custkey"]).project(["c_mktsegment", "o_orderstatus"]).distinct().to_bag()


@query(f"SELECT n_name, o_orderstatus, {_N} AS n FROM {_OC} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def join_three(spark, d):
    nations = rel(spark, d, "nation", "n_nationkey", "n_name").map_rows({"nationkey": F.col("n_nationkey"), "n_name": F.col("n_name")})
    return _orders(spark, d).join(_customers(spark, d), ["custkey"]).join(nations, ["nationkey"]).project(["n_name", "o_orderstatus"]).annotated()


@query("SELECT c.k AS k, CAST(c.n * s.n AS BIGINT) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def join_multiplicity(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")})
    return a.join(rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")}), ["k"]).annotated()


_NULLED = "SELECT {t}_nationkey AS v, CASE WHEN {t}_nationkey % 5 = 0 THEN NULL ELSE {t}_nationkey END AS k FROM {n}"


def _nulled(spark, d, name, out):
    c = f"{name[0]}_nationkey"
    return rel(spark, d, name, c).map_rows({out: F.col(c), "k": F.when(F.col(c) % 5 == 0, F.lit(None).cast("int")).otherwise(F.col(c))})


@query(f"SELECT a.k AS k, a.v AS a, b.v AS b, {_N} AS n FROM ({_NULLED.format(t='s', n='supplier')}) a JOIN ({_NULLED.format(t='n', n='nation')}) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1, 2, 3")
def join_null_keys(spark, d):
    return _nulled(spark, d, "supplier", "a").join(_nulled(spark, d, "nation", "b"), ["k"]).annotated()


# -- distinct
@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return rel(spark, d, "orders", "o_orderstatus", "o_orderpriority").distinct().to_bag()


@query("SELECT DISTINCT l_partkey FROM lineitem")
def project_distinct(spark, d):
    return rel(spark, d, "lineitem", *LI).project(["l_partkey"]).distinct().to_bag()


@query("SELECT DISTINCT l_returnflag, CAST(1 AS BIGINT) AS n FROM lineitem")
def distinct_collapse_annotation(spark, d):
    return rel(spark, d, "lineitem", "l_returnflag").distinct().annotated()


# -- anti-join
_SOME = "o_orderstatus = 'F' AND o_orderkey % 4 = 0"


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_SOME})")
def anti_join(spark, d):
    c = rel(spark, d, "customer", "c_custkey").map_rows({"k": F.col("c_custkey")})
    o = rel(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.expr(_SOME)).map_rows({"k": F.col("o_custkey")})
    return c.anti_join(o, ["k"]).map_rows({"c_custkey": F.col("k")}).to_bag()


@query(f"SELECT c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_SOME})")
def anti_join_project(spark, d):
    o = rel(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.expr(_SOME)).map_rows({"custkey": F.col("o_custkey")})
    return _customers(spark, d).anti_join(o, ["custkey"]).project(["c_mktsegment"]).to_bag()


@query(f"SELECT a.k AS k, a.v AS a FROM ({_NULLED.format(t='s', n='supplier')}) a WHERE NOT EXISTS (SELECT 1 FROM ({_NULLED.format(t='n', n='nation')}) b WHERE a.k IS NOT DISTINCT FROM b.k AND b.v < 12)")
def anti_join_null_keys(spark, d):
    return _nulled(spark, d, "supplier", "a").anti_join(_nulled(spark, d, "nation", "b").select(F.col("b") < 12), ["k"]).to_bag()


# -- compositions
@query("SELECT c_custkey AS custkey, c_mktsegment, c_nationkey AS nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join_composed(spark, d):
    return _customers(spark, d).join(_orders(spark, d).project(["custkey"]).distinct(), ["custkey"]).to_bag()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
def intersect_composed(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")})
    return a.join(rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")}).select(F.col("k") > 5), ["k"]).distinct().to_bag()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5")
def except_composed(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")}).distinct()
    return a.anti_join(rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")}).select(F.col("k") > 5), ["k"]).to_bag()


# -- aggregate
@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM lineitem GROUP BY 1")
def agg_sum(spark, d):
    return rel(spark, d, "lineitem", *LI).aggregate(["l_returnflag"], A.SUM, F.col("l_quantity"), "total").to_bag()


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY 1")
def agg_count(spark, d):
    out = rel(spark, d, "lineitem", *LI).aggregate(["l_returnflag"], A.SUM, F.lit(1), "n_rows").to_bag()
    return out.withColumn("n_rows", F.col("n_rows").cast("long"))


@query("SELECT l_returnflag, CAST(min(l_quantity) AS DECIMAL(12,2)) AS least FROM lineitem GROUP BY 1")
def agg_min(spark, d):
    return rel(spark, d, "lineitem", *LI).aggregate(["l_returnflag"], A.MIN, F.col("l_quantity"), "least").to_bag()


@query("SELECT l_returnflag, CAST(max(l_quantity) AS DECIMAL(12,2)) AS most FROM lineitem GROUP BY 1")
def agg_max(spark, d):
    return rel(spark, d, "lineitem", *LI).aggregate(["l_returnflag"], A.MAX, F.col("l_quantity"), "most").to_bag()


@query(f"SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders FROM {_OC} GROUP BY 1")
def agg_of_join(spark, d):
    out = _orders(spark, d).join(_customers(spark, d), ["custkey"]).aggregate(["c_mktsegment"], A.SUM, F.lit(1), "n_orders").to_bag()
    return out.withColumn("n_orders", F.col("n_orders").cast("long"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def agg_of_distinct(spark, d):
    out = rel(spark, d, "lineitem", "l_returnflag", "l_partkey").distinct().aggregate(["l_returnflag"], A.SUM, F.lit(1), "parts").to_bag()
    return out.withColumn("parts", F.col("parts").cast("long"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(38,4)) AS total FROM lineitem GROUP BY 1, 2")
def agg_two_keys(spark, d):
    return rel(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").aggregate(["l_returnflag", "l_linestatus"], A.SUM, F.col("l_quantity"), "total").to_bag()


@query("SELECT n_regionkey, string_agg(n_name, '' ORDER BY '{\"n_name\":\"' || n_name) AS names FROM nation GROUP BY 1")
def agg_ordered_fold(spark, d):
    return rel(spark, d, "nation", "n_regionkey", "n_name").aggregate(["n_regionkey"], A.CONCAT, F.col("n_name"), "names").to_bag()


@query("SELECT s_nationkey % 4 AS g, CAST(sum(CASE WHEN s_nationkey = 6 THEN NULL ELSE s_suppkey END) AS DECIMAL(38,4)) AS total FROM supplier GROUP BY 1 HAVING count(*) = count(CASE WHEN s_nationkey = 6 THEN NULL ELSE s_suppkey END)")
def agg_null_group(spark, d):
    s = rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows({"g": F.col("s_nationkey") % 4, "x": F.when(F.col("s_nationkey") != 6, F.col("s_suppkey")), "id": F.col("s_suppkey")})
    return s.aggregate(["g"], A.SUM, F.col("x"), "total").to_bag()


@query("SELECT 'aggregate' AS operator, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_nationkey % 4 IN (SELECT s_nationkey % 4 FROM supplier WHERE s_nationkey = 6) HAVING count(*) > 0")
def agg_null_quarantine(spark, d):
    s = rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows({"g": F.col("s_nationkey") % 4, "x": F.when(F.col("s_nationkey") != 6, F.col("s_suppkey")), "id": F.col("s_suppkey")})
    return s.aggregate(["g"], A.SUM, F.col("x"), "total").quarantine().groupBy("operator").agg(F.sum("n").cast("long").alias("n"))


@query("SELECT c_mktsegment, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DECIMAL(38,4)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def revenue_by_segment(spark, d):
    li = rel(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").map_rows({"orderkey": F.col("l_orderkey"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount")})
    o = rel(spark, d, "orders", "o_orderkey", "o_custkey").map_rows({"orderkey": F.col("o_orderkey"), "custkey": F.col("o_custkey")})
    c = rel(spark, d, "customer", "c_custkey", "c_mktsegment").map_rows({"custkey": F.col("c_custkey"), "c_mktsegment": F.col("c_mktsegment")})
    joined = li.join(o, ["orderkey"]).join(c, ["custkey"])
    return joined.aggregate(["c_mktsegment"], A.SUM, F.col("price") * (1 - F.col("discount")), "revenue").to_bag()


flagship = revenue_by_segment


@query("SELECT o_orderstatus, CAST(sum(o_custkey % 7 + length(o_orderpriority)) AS BIGINT) AS total FROM orders GROUP BY 1")
def agg_sum_of_expression(spark, d):
    o = rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.aggregate(["o_orderstatus"], A.SUM_LONG, F.col("o_custkey") % 7 + F.length("o_orderpriority"), "total").to_bag()


@query("SELECT s_nationkey % 4 AS g, CAST(sum(100 // s_nationkey) AS BIGINT) AS total FROM supplier WHERE s_nationkey <> 0 GROUP BY 1")
def agg_value_callable(spark, d):
    ship(spark)
    s = rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows({"g": F.col("s_nationkey") % 4, "k": F.col("s_nationkey"), "id": F.col("s_suppkey")})
    return s.aggregate(["g"], A.SUM_LONG, lambda r: 100 // r["k"], "total").to_bag()


@query("SELECT 'aggregate' AS operator, 'ZeroDivisionError' AS reason, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_nationkey = 0 HAVING count(*) > 0")
def agg_value_callable_quarantine(spark, d):
    ship(spark)
    s = rel(spark, d, "supplier", "s_suppkey", "s_nationkey").map_rows({"g": F.col("s_nationkey") % 4, "k": F.col("s_nationkey"), "id": F.col("s_suppkey")})
    out = s.aggregate(["g"], A.SUM_LONG, lambda r: 100 // r["k"], "total").quarantine()
    return out.groupBy("operator", "reason").agg(F.sum("n").cast("long").alias("n"))


def _gcd(a, b):
    while b:
        a, b = b, a % b
    return a


GCD = A.Monoid("gcd", _gcd, 0, (0, 4, 6, 9), kind="long")


@query("SELECT n_regionkey, list_reduce(list(CAST(6 * n_nationkey AS BIGINT)), lambda a, b: gcd(a, b)) AS g FROM nation GROUP BY 1")
def agg_user_monoid(spark, d):
    ship(spark)
    return rel(spark, d, "nation", "n_nationkey", "n_regionkey").aggregate(["n_regionkey"], GCD, (F.col("n_nationkey") * 6).cast("long"), "g").to_bag()


@query("SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') AS ts FROM events")
def times_as_text(spark, d):
    return rel(spark, d, "events", "event_id", "ts").to_bag()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, true AS b FROM orders")
def set_annotation(spark, d):
    return rel(spark, d, "orders", "o_orderstatus", "o_orderpriority", semiring=S.B).annotated()


@query(f"SELECT o_orderstatus, {_N} AS l_n, {_N} AS r_l_n, true AS r_r_b FROM orders GROUP BY 1")
def product_annotation(spark, d):
    return rel(spark, d, "orders", "o_orderkey", "o_orderstatus", semiring=S.named("Z*(Z*B)")).project(["o_orderstatus"]).annotated()


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, CAST(l_tax AS DECIMAL(12,2)) AS l_tax FROM lineitem")
def lossy_door(spark, d):
    return rel(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax").to_bag()


# -- provenance
_REF = "'sha256:' || sha256('{\"row\":{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '},\"source\":\"nation\",\"tag\":\"srcrow/1\"}')"


def _nation(spark, d):
    return ingest(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "nation")


@query(f"SELECT n_nationkey, {_REF} AS ref FROM nation")
def canonical_row_ref(spark, d):
    n = _nation(spark, d)
    return n.df.select("n_nationkey", n.row_refs("nation").alias("ref"))


@query(f"SELECT n_regionkey, {_N} AS n, string_agg(ref, ';' ORDER BY ref) AS w FROM (SELECT n_regionkey, {_REF} AS ref FROM nation) GROUP BY 1")
def why_project(spark, d):
    return _nation(spark, d).project(["n_regionkey"]).annotated()


@query(f"SELECT n_nationkey, CAST(2 AS BIGINT) AS n, {_REF} AS w FROM nation")
def why_union_antichain(spark, d):
    n = _nation(spark, d).project(["n_nationkey"])
    return n.union(n).annotated()


@query(f"SELECT a.n_regionkey AS n_regionkey, a.k AS k, b.j AS j, CAST(1 AS BIGINT) AS n, least(a.ref, b.ref) || CASE WHEN a.ref = b.ref THEN '' ELSE '|' || greatest(a.ref, b.ref) END AS w FROM (SELECT n_regionkey, n_nationkey AS k, {_REF} AS ref FROM nation) a JOIN (SELECT n_regionkey, n_nationkey AS j, {_REF} AS ref FROM nation) b ON a.n_regionkey = b.n_regionkey")
def why_join(spark, d):
    n = _nation(spark, d).project(["n_nationkey", "n_regionkey"])
    a = n.map_rows({"k": F.col("n_nationkey"), "n_regionkey": F.col("n_regionkey")})
    return a.join(n.map_rows({"j": F.col("n_nationkey"), "n_regionkey": F.col("n_regionkey")}), ["n_regionkey"]).annotated()


@query()
def why_absence_witness(spark, d):
    n = _nation(spark, d).project(["n_nationkey", "n_regionkey"])
    gone = ingest(table(spark, d, "region", "r_regionkey"), "region").map_rows({"n_regionkey": F.col("r_regionkey")}).select(F.col("n_regionkey") < 2)
    return n.anti_join(gone, ["n_regionkey"]).annotated()


@query(f"SELECT n_regionkey, {_N} AS n, string_agg(ref, ';' ORDER BY ref) AS w FROM (SELECT n_regionkey, {_REF} AS ref FROM nation WHERE n_nationkey <> 7) GROUP BY 1")
def deletion_survivors(spark, d):
    n = _nation(spark, d)
    gone = n.select(F.col("n_nationkey") == 7)
    left = D.apply(n, D.negate(gone), gone.df.select(n.row_refs("nation").alias("ref")))
    return left.project(["n_regionkey"]).annotated()


@query(f"SELECT n_regionkey, {_REF} AS ref, 'source-row' AS kind, 'nation' AS source FROM nation")
def lineage_citations(spark, d):
    n = _nation(spark, d)
    return lineage(n.project(["n_regionkey"]), source_rows(n, "nation"), ["n_regionkey"]).select("n_regionkey", "ref", "kind", "source")


@query(f"SELECT n_regionkey, string_agg('source-row:' || ref, ',' ORDER BY ref) AS cited FROM (SELECT n_regionkey, {_REF} AS ref FROM nation) GROUP BY 1")
def lineage_of_store(spark, d):
    store = Store(spark, fresh_folder(spark, "store"))
    n = ingest(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "nation", store)
    ingest(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), "nation", store)  # adds nothing
    out = citations(n.project(["n_regionkey"]).consolidated(), store.rows(), ["n_regionkey"])
    each = F.transform(F.flatten("citations"), lambda c: F.concat(c["kind"], F.lit(":"), c["ref"]))
    return out.select("n_regionkey", F.array_join(each, ",").alias("cited"))


@query()
def relation_address(spark, d):
    r = ingest(table(spark, d, "region", "r_regionkey", "r_name"), "region")
    return spark.createDataFrame([(r.address(),)], "address string")


# -- changes
@query("SELECT o_orderstatus, CAST(-count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def delta_negate(spark, d):
    return D.negate(rel(spark, d, "orders", "o_orderstatus")).annotated()


@query("SELECT k, CAST(sum(s) AS BIGINT) AS n FROM (SELECT c_nationkey AS k, 1 AS s FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY 1 HAVING sum(s) <> 0")
def delta_diff(spark, d):
    a = rel(spark, d, "customer", "c_nationkey").map_rows({"k": F.col("c_nationkey")})
    return D.diff(a, rel(spark, d, "supplier", "s_nationkey").map_rows({"k": F.col("s_nationkey")})).annotated()


@query("SELECT o_orderkey, o_custkey, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 1")
def delta_apply(spark, d):
    o = rel(spark, d, "orders", "o_orderkey", "o_custkey")
    return D.apply(o, D.negate(o.select(F.col("o_orderkey") % 3 == 1))).annotated()


@query(f"SELECT c_mktsegment, {_N} AS n FROM {_OC} WHERE o_orderkey % 3 = 2 OR c_custkey % 4 = 1 GROUP BY 1")
def delta_join(spark, d):
    o, c = _orders(spark, d), _customers(spark, d)
    new_o, new_c = F.col("o_orderkey") % 3 == 2, F.col("custkey") % 4 == 1
    return D.join_delta(o, o.select(new_o), c.select(~new_c), c.select(new_c), ["custkey"]).project(["c_mktsegment"]).annotated()


@query("SELECT o_orderstatus, CAST(sum(o_custkey) AS DECIMAL(38,4)) AS total, CAST(count(*) AS BIGINT) AS members FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def delta_agg_subtractive(spark, d):
    o = rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    old = o.df.groupBy("o_orderstatus").agg(F.sum(F.col("o_custkey").cast("decimal(38,4)")).cast("decimal(38,4)").alias("total"), F.sum("__n").cast("long").alias("__rows"))
    out = D.group_aggregate_delta(D.negate(o.select(F.col("o_orderkey") % 5 == 0)), ["o_orderstatus"], A.SUM_GROUP, F.col("o_custkey"), "total", old)
    return out.withColumnRenamed("__rows", "members")


def _maintained(spark, d, plan: Plan, cols: tuple[str, ...], semiring: S.Semiring, **more: DataFrame) -> Maintained:
    """orders arrive by key modulo 3; tick 1 also retracts a fifth of tick 0, tick 2 lets half of those
    return. Other sources are whole from tick 0 on, but for their every seventh row, which comes with
    tick 1. semiring: Z where a query reads counts only, as provenance would be made and not read."""
    view = Maintained(spark, fresh_folder(spark, "ticks"), plan, semiring)
    orders, k = table(spark, d, "orders", *cols), F.col("o_orderkey")
    plus = lambda df: df.withColumn("occ", F.lit(1).cast("long"))
    minus = lambda df: df.withColumn("occ", F.lit(-1).cast("long"))
    gone = orders.where((k % 3 == 0) & (k % 5 == 0))
    late = lambda df: F.col(next(c for c in df.columns if c.endswith("key"))) % 7 == 0
    view.advance({"orders": plus(orders.where(k % 3 == 0)), **{n: plus(x.where(~late(x))) for n, x in more.items()}}, 0)
    view.advance({"orders": plus(orders.where(k % 3 == 1)).union(minus(gone)), **{n: plus(x.where(late(x))) for n, x in more.items()}}, 1)
    view.advance({"orders": plus(orders.where(k % 3 == 2)).union(plus(gone.where(k % 2 == 0)))}, 2)
    if view.advance({}, 2).rebuilt:
        raise AssertionError("a tick was done twice")
    return view


_HELD = "NOT (o_orderkey % 15 = 0 AND o_orderkey % 2 = 1)"


@query(f"SELECT o_orderstatus, {_N} AS n FROM orders WHERE {_HELD} GROUP BY 1")
def stream_orders_ticks(spark, d):
    cols = ("o_orderkey", "o_orderstatus")
    plan = Plan().add("orders", DeltaNode("source", schema=cols)).add("states", DeltaNode("project", columns=["o_orderstatus"]), "orders")
    return _maintained(spark, d, plan, cols, S.Z).integral("states").annotated()


@query(f"SELECT o_orderkey, o_custkey * 2 AS twice FROM orders WHERE {_HELD} AND o_custkey > 50")
def stream_linear_ticks(spark, d):
    cols = ("o_orderkey", "o_custkey")
    plan = (
        Plan().add("orders", DeltaNode("source", schema=cols)).add("some", DeltaNode("select", predicate="o_custkey > 50"), "orders")
        .add("out", DeltaNode("map_rows", cells={"o_orderkey": "o_orderkey", "twice": "o_custkey * 2"}), "some")
    )
    return _maintained(spark, d, plan, cols, S.Z).integral("out").to_bag()


@query(f"SELECT c_mktsegment, o_orderkey, {_N} AS n FROM {_OC} WHERE {_HELD} GROUP BY 1, 2")
def stream_bilinear_ticks(spark, d):
    cols = ("o_orderkey", "o_custkey")
    plan = (
        Plan().add("orders", DeltaNode("source", schema=cols)).add("customers", DeltaNode("source", schema=("c_custkey", "c_mktsegment")))
        .add("keyed", DeltaNode("map_rows", cells={"o_custkey": "c_custkey", "c_mktsegment": "c_mktsegment"}), "customers")
        .add("both", DeltaNode("join", on=["o_custkey"]), "orders", "keyed").add("out", DeltaNode("project", columns=["c_mktsegment", "o_orderkey"]), "both")
    )
    return _maintained(spark, d, plan, cols, S.Z, customers=table(spark, d, "customer", "c_custkey", "c_mktsegment")).integral("out").annotated()


@query(f"SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE {_HELD} GROUP BY 1")
def stream_subtractive_ticks(spark, d):
    cols = ("o_orderkey", "o_custkey", "o_orderstatus")
    plan = Plan().add("orders", DeltaNode("source", schema=cols)).add("out", DeltaNode("aggregate", by=["o_orderstatus"], algebra="sum-long", value="o_custkey", into="total"), "orders")
    return _maintained(spark, d, plan, cols, S.Z).integral("out").to_bag()


@query(f"SELECT o_orderstatus, CAST(max(o_custkey) AS BIGINT) AS most FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders WHERE {_HELD}) GROUP BY 1")
def stream_distinct_ticks(spark, d):
    cols = ("o_orderkey", "o_custkey", "o_orderstatus")
    plan = (
        Plan().add("orders", DeltaNode("source", schema=cols)).add("pairs", DeltaNode("project", columns=["o_orderstatus", "o_custkey"]), "orders")
        .add("each", DeltaNode("distinct"), "pairs").add("out", DeltaNode("aggregate", by=["o_orderstatus"], algebra="max", value="o_custkey", into="most"), "each")
    )
    return _maintained(spark, d, plan, cols, S.Z).integral("out").to_bag()


@query(f"SELECT o_custkey, {_N} AS n FROM orders WHERE {_HELD} AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def stream_anti_join_ticks(spark, d):
    cols = ("o_orderkey", "o_custkey")
    plan = (
        Plan().add("orders", DeltaNode("source", schema=cols)).add("customers", DeltaNode("source", schema=("c_custkey", "c_mktsegment")))
        .add("building", DeltaNode("select", predicate="c_mktsegment = 'BUILDING'"), "customers")
        .add("keyed", DeltaNode("map_rows", cells={"o_custkey": "c_custkey"}), "building")
        .add("left_", DeltaNode("anti_join", on=["o_custkey"]), "orders", "keyed").add("out", DeltaNode("project", columns=["o_custkey"]), "left_")
    )
    return _maintained(spark, d, plan, cols, S.Z, customers=table(spark, d, "customer", "c_custkey", "c_mktsegment")).integral("out").annotated()


# -- builds, captures, comparison
@transform(kind="query")
def nations_of_region_one(nation: Rel) -> Rel:
    return nation.select(F.col("n_regionkey") == 1).project(["n_name"])


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def memoised_build_export(spark, d):
    store = Store(spark, fresh_folder(spark, "store"))
    ref = store.put(rel(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"))
    store.build(nations_of_region_one, [ref])
    again = store.build(nations_of_region_one, [ref])
    if again.rebuilt:
        raise AssertionError("the trace was not used")
    return store.export(again)


@query("SELECT 'run' AS scope, CASE WHEN s_nationkey % 2 = 0 THEN 'llm' ELSE 'fetch' END AS kind, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE s_suppkey % 50 END) AS BIGINT) AS spent FROM supplier GROUP BY 2")
def spend_fold(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    kind = F.when(F.col("s_nationkey") % 2 == 0, "llm").otherwise("fetch")
    reserved = s.select(F.col("s_suppkey").cast("string").alias("id"), F.lit("run").alias("scope"), F.lit("unit").alias("unit"), kind.alias("kind"), F.lit(100).cast("long").alias("worst"))
    captured = s.where(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").cast("string").alias("reservation"), (F.col("s_suppkey") % 50).alias("price"))
    return captures.spent(reserved, captured).select("scope", "kind", "spent")


@query("SELECT o_orderkey AS item, CAST(0 AS BIGINT) AS \"offset\", 'differs' AS classification FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey % 11 <> 3 UNION ALL SELECT o_orderkey, NULL, 'missing' FROM orders WHERE o_orderkey % 11 = 3")
def byte_compare(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    ours = o.where("o_orderkey % 11 <> 3").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("output"))
    return compare.compare(o.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("output")), ours)


@query("SELECT p_brand AS candidate, CAST(sum(p_size) * count(DISTINCT p_type) AS BIGINT) AS weight FROM part GROUP BY 1 ORDER BY 2, count(DISTINCT p_type), 1 LIMIT 1")
def select_vertical(spark, d):
    p = table(spark, d, "part", "p_brand", "p_size", "p_type").groupBy(F.col("p_brand").alias("candidate")).agg(F.sum("p_size").alias("loc"), F.collect_set("p_type").alias("operators"))
    return compare.select_vertical(p).select("candidate", "weight")
