"""Relational operators on the star schema: joins, aggregates, windows, sets, changes, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import retention as log
from millrace.plans.registry import register
from millrace.sources import tables as S


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = S.table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@register("customers_without_orders", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def customers_without_orders(spark, d):
    """Customers without an urgent order."""
    orders = S.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@register("urgent_customers", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def urgent_customers(spark, d):
    orders = S.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@register("nation_dashboard", """SELECT r.r_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations,
  (SELECT count(*) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey) AS customers FROM region r""")
def nation_dashboard(spark, d):
    nation = S.table(spark, d, "nation")
    by_nation = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"))
    people = S.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("customers"))
    rows = S.table(spark, d, "region").join(by_nation.join(people, "n_regionkey", "left"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("r_name", F.coalesce("nations", F.lit(0)).cast("bigint").alias("nations"), F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"))


@register("latest_order", """SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN LATERAL
  (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def latest_order(spark, d):
    orders = S.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return S.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@register("top_parts_per_brand", """SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS k FROM part
  QUALIFY k <= 3""")
def top_parts_per_brand(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return S.table(spark, d, "part").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("p_brand", "p_partkey", "k")


@register("full_outer_counts", """SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers FROM
  (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def full_outer_counts(spark, d):
    a = S.table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    b = S.table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nationkey", "full")


@register("union_limited", """SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)""")
def union_limited(spark, d):
    a = S.table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    b = S.table(spark, d, "supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(5).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


@register("keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def keyset_page(spark, d):
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    rows = S.table(spark, d, "orders").filter((F.col("o_orderdate") > at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") > 500)))
    return rows.orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


def _before(spark, d):
    return S.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select("c_custkey", "c_mktsegment", F.sha2(F.concat_ws("|", "c_name", F.when(F.col("c_custkey") % 7 == 0, "old").otherwise("new")), 256).alias("digest"))


def _after(spark, d):
    return S.table(spark, d, "customer").filter("c_custkey % 11 <> 0").select("c_custkey", "c_mktsegment", F.sha2(F.concat_ws("|", "c_name", F.lit("new")), 256).alias("digest"))


@register("change_detection", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer WHERE c_custkey % 11 <> 0""")
def change_detection(spark, d):
    return log.changed(_before(spark, d), _after(spark, d), ["c_custkey"], "digest").select("c_custkey", "change")


@register("vanished", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 = 0")
def vanished(spark, d):
    return log.vanished(_before(spark, d), _after(spark, d), ["c_custkey"]).select("c_custkey")


@register("upsert", """SELECT c_custkey, sha256(c_name || '|' || CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 = 0 THEN 'old' ELSE 'new' END) AS digest FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 11 <> 0""")
def upsert(spark, d):
    return log.upserted(_before(spark, d), _after(spark, d), ["c_custkey"]).select("c_custkey", "digest")


@register("replace_children", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 2 = 1 OR l_linenumber <= 2""")
def replace_children(spark, d):
    old = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.filter("l_orderkey % 2 = 0 AND l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    gone = old.filter("l_orderkey % 2 = 0").join(new.select("l_orderkey").distinct(), "l_orderkey", "left_anti")
    return log.replaced_children(old, new, ["l_orderkey"]).join(gone.select("l_orderkey").distinct(), "l_orderkey", "left_anti")


@register("state_fold", """SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def state_fold(spark, d):
    return log.latest(S.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@register("audit_trail", """SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_value FROM orders""")
def audit_trail(spark, d):
    return log.audited(S.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus", "old_value")


@register("queue_claim", """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) - 1) % 4 AS INT) AS worker FROM
  (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 80)""")
def queue_claim(spark, d):
    batch = S.table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(80)
    w = Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")  # over the claimed batch only
    return batch.select("o_orderkey", ((F.row_number().over(w) - 1) % 4).cast("int").alias("worker"))


@register("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def row_counts(spark, d):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = S.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("reorder", "SELECT unnest([7, 3, 9, 1]) AS bet_id, generate_subscripts([7, 3, 9, 1], 1)::INT AS position")
def reorder(spark, d):
    rows = spark.createDataFrame([([7, 3, 9, 1],)], "ids array<int>")
    return rows.select(F.posexplode("ids").alias("position", "bet_id")).select("bet_id", (F.col("position") + 1).alias("position"))
