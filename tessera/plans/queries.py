"""Queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower
from tessera.functions.vectors import cosine
from tessera.operators.aggregates import exact, exact_quantiles, exact_sum, histogram, hundredths
from tessera.operators.joins import as_of_join, range_join, salted_join
from tessera.operators.windows import gap_filled, latest, sessions, top_k

from .registry import query, read

REVENUE_SQL = "CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(18, 2)))"


def revenue() -> Column:
    return exact_sum(hundredths("l_extendedprice") * (100 - hundredths("l_discount")), 4)


@query(f"""SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS sum_qty, sum({REVENUE_SQL})::DOUBLE AS revenue,
    count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02'")
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(hundredths("l_quantity")).alias("sum_qty"), revenue().alias("revenue"), F.count("*").alias("n")
    )


@query(f"""SELECT sum({REVENUE_SQL})::DOUBLE AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
    AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")
def filter_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .where("l_shipdate >= timestamp_ntz '1996-01-01' AND l_shipdate < timestamp_ntz '1997-01-01' AND l_discount BETWEEN 0.045D AND 0.075D AND l_quantity < 24")
        .agg(revenue().alias("revenue"))
    )


@query(f"""SELECT n_name AS nation, sum({REVENUE_SQL})::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def join_local_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, customer, supplier, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("nation")).agg(revenue().alias("revenue"))
    )


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customer = read(spark, sf_dir, "customer")
    return customer.join(urgent, customer.c_custkey == urgent.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, back = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return orders.join(back, orders.o_orderkey == back.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def join_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("""SELECT coalesce(s, c) AS nationkey, coalesce(n_s, 0) AS n_suppliers, coalesce(n_c, 0) AS n_customers FROM
    (SELECT s_nationkey AS s, count(*) AS n_s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS c, count(*) AS n_c FROM customer GROUP BY 1) ON s = c""")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    return s.join(c, "nationkey", "full").na.fill(0, ["n_suppliers", "n_customers"])


@query("""SELECT p.event_id, p.user_id, coalesce((SELECT max(c.event_id) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts =
    (SELECT max(x.ts) FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'click' AND x.ts <= p.ts)), -1) AS click_id
    FROM events p WHERE p.event_type = 'purchase'""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    bought = events.where("event_type = 'purchase'").drop("event_type")
    return as_of_join(bought, clicks, "ts", ["user_id"], ["click_id"], F.to_date).na.fill(-1, ["click_id"]).select("event_id", "user_id", "click_id")


@query("""SELECT p_partkey, count(*) AS n_events, sum(event_id)::BIGINT AS event_ids FROM events JOIN part ON floor(value) >= p_size AND floor(value) < p_size + 3 GROUP BY 1""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a band from each part's size: events are combined by whole value before they meet the parts."""
    events = read(spark, sf_dir, "events").groupBy(F.floor("value").alias("v")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    met = range_join(events, part, F.col("v"), F.col("p_size"), F.col("p_size") + 3, 4)
    return met.groupBy("p_partkey").agg(F.sum("n").alias("n_events"), F.sum("ids").alias("event_ids"))


@query("""SELECT event_type, c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    joined = salted_join(events, read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return joined.groupBy("event_type", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def agg_salted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot source needs no salt here: sums are combined in each task before the shuffle."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2")
    )


@query("""SELECT strftime(o_orderdate, '%Y') AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (y, o_orderstatus)""")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("y", F.date_format("o_orderdate", "yyyy")).rollup("y", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, bool_or(p_size > 45) AS any_large,
    max_by(p_partkey, p_retailprice * 100000 + p_partkey / 1000000) AS dearest FROM part GROUP BY 1""")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_distinct("p_type").alias("types"),
        F.count_distinct("p_size").alias("sizes"),
        F.bool_or(F.col("p_size") > 45).alias("any_large"),
        F.max_by("p_partkey", F.col("p_retailprice") * 100000 + F.col("p_partkey") / 1000000).alias("dearest"),
    )


@query("""SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, min(c_acctbal) AS low FROM customer GROUP BY 1""")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    at = exact_quantiles(customer, "c_mktsegment", "c_acctbal", [0.5, 0.9]).groupBy("c_mktsegment").pivot("q", [0.5, 0.9]).agg(F.round(F.first("value"), 4))
    low = customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"))
    return low.join(at, "c_mktsegment", "left").select("c_mktsegment", F.col("`0.5`").alias("median"), F.col("`0.9`").alias("p90"), "low")


@query("""SELECT floor(o_totalprice / 10000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1""")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read(spark, sf_dir, "orders"), "o_totalprice", 10000)


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
    count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count().na.fill(0)


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def agg_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("""SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def window_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return top_k(read(spark, sf_dir, "orders"), ["o_custkey"], order, 3).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def window_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n_events FROM b GROUP BY user_id, s""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(read(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("""SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::DOUBLE AS running,
    lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous,
    ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS quarter FROM orders""")
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.sum(exact("o_totalprice")).over(along).cast("double").alias("running"),
        F.lag("o_orderkey", 1, -1).over(along).alias("previous"),
        F.ntile(4).over(along).alias("quarter"),
    )


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_day FROM events""")
def window_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_day FROM {events}",
        events=read(spark, sf_dir, "events"),
    )


@query("""WITH e AS (SELECT user_id, ts::DATE AS day, max(event_id) AS last_event FROM events GROUP BY 1, 2),
    d AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY 1)
    SELECT d.user_id, strftime(d.day, '%Y-%m-%d') AS day, last_value(e.last_event IGNORE NULLS) OVER (PARTITION BY d.user_id ORDER BY d.day) AS last_event
    FROM d LEFT JOIN e ON e.user_id = d.user_id AND e.day = d.day""")
def window_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("event_id").alias("last_event"))
    return gap_filled(days, "user_id", "day", "last_event").withColumn("day", F.col("day").cast("string"))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def time_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), "event_type", "n")


@query("""SELECT b AS begins, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1""")
def time_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), "n")


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""SELECT l_partkey AS k FROM lineitem EXCEPT ALL SELECT p_partkey FROM part""")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).exceptAll(read(spark, sf_dir, "part").select("p_partkey"))


@query("""SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION SELECT 'supplier', s_nationkey FROM supplier""")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"))
    return c.union(read(spark, sf_dir, "supplier").select(F.lit("supplier"), "s_nationkey")).distinct()


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, (json_extract(props, '$.k')::BIGINT % 2 = 0) AS even FROM events""")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("""SELECT c_custkey, upper(c_name) AS name, lpad(c_custkey::VARCHAR, 8, '0') AS code, reverse(c_mktsegment) AS back, md5(c_name) AS digest,
    CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer""")
def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("name"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"),
        F.reverse("c_mktsegment").alias("back"),
        F.md5("c_name").alias("digest"),
        band.alias("band"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS d,
    strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS age FROM orders""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(at).alias("y"),
        F.quarter(at).alias("q"),
        F.dayofyear(at).alias("d"),
        F.date_format(at, "yyyy-MM").alias("month"),
        F.datediff(F.to_date(at), F.lit("1995-01-01").cast("date")).alias("age"),
    )


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents) GROUP BY 1""")
def text_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words, A-Z lower-cased: digits, letters and whatever lies outside ASCII."""
    words = F.explode(F.split(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("word")
    return read(spark, sf_dir, "documents").select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def text_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles")
    )


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY ALL),
    k AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), centre), 6) AS similarity FROM embeddings JOIN k USING (label)""")
def vector_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    return vectors.join(centres, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


@query()
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: distinct parts and price quantiles for each supplier's nation, within known error bounds."""
    lineitem, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    return (
        lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .groupBy("s_nationkey")
        .agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", [0.5, 0.95], 1000).alias("prices"))
    )
