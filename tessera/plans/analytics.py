"""More queries over the given tables: several operators of one family in each, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import exact, exact_quantiles
from tessera.operators.recursion import descend
from tessera.sources.shared import shared_folder

from .registry import query, read

SUBQUERIES = """SELECT o_orderkey, o_custkey FROM {orders} o WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    AND o_totalprice > (SELECT avg(CAST(x.o_totalprice AS DECIMAL(18, 2))) FROM {orders} x WHERE x.o_custkey = o.o_custkey)
    AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    AND {without}"""
# Spark broadcasts what NOT IN looks at, whatever its size; NOT EXISTS is an anti-join, and keys are never null here.
NOT_IN = "o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity = 50)"
NOT_EXISTS = "NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity = 50)"
LATERAL = """SELECT n_name, n, dearest FROM {nation}, LATERAL (SELECT count(*) AS n, max(s_acctbal) AS dearest FROM {supplier} WHERE s_nationkey = n_nationkey) AS s"""
TREE = """WITH RECURSIVE t(k, depth) AS (SELECT c_custkey, 0 FROM {customer} WHERE c_custkey < 4
    UNION ALL SELECT c_custkey, depth + 1 FROM t JOIN {customer} ON CAST(floor(c_custkey / 4.0) AS BIGINT) = k WHERE c_custkey >= 4)
    SELECT depth, count(*) AS n, sum(k)::BIGINT AS keys FROM t GROUP BY depth"""


def named(sql: str, *tables: str) -> str:
    """The text with the tables' own names."""
    return sql.format(**{t: t for t in tables})


@query("""SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_linestatus = 'O')::DOUBLE AS open_qty,
    count(DISTINCT l_partkey) FILTER (l_discount > 0.05) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 20 AND max(l_quantity) >= 49""")
def agg_filter_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum(F.when(F.col("l_linestatus") == "O", exact("l_quantity"))).cast("double").alias("open_qty"),
        F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("parts"),
        F.max("l_quantity").alias("most"),
    )
    return groups.where("n > 20 AND most >= 49").drop("most")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS level FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return read(spark, sf_dir, "lineitem").groupingSets([[a, b], [b], []], a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""WITH m AS (SELECT l_returnflag AS flag, avg(l_quantity) AS a, avg(l_quantity ** 2) AS b, avg(l_quantity ** 3) AS c, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS deviation, round(var_pop(l_quantity), 4) AS variance, round(corr(l_quantity, l_extendedprice), 4) AS correlation,
    round(kurtosis_pop(l_quantity), 3) AS kurtosis, round(any_value((c - 3 * a * b + 2 * a ** 3) / v ** 1.5), 3) AS skewness, round(regr_slope(l_tax, l_discount), 4) AS slope
    FROM lineitem JOIN m ON flag = l_returnflag GROUP BY 1""")
def agg_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 4).alias("deviation"),
        F.round(F.var_pop("l_quantity"), 4).alias("variance"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("correlation"),
        F.round(F.kurtosis("l_quantity"), 3).alias("kurtosis"),
        F.round(F.skewness("l_quantity"), 3).alias("skewness"),
        F.round(F.regr_slope("l_tax", "l_discount"), 4).alias("slope"),
    )


@query("""WITH t AS (SELECT l_returnflag, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS quantity, sum(CAST(l_tax AS DECIMAL(18, 2)))::DOUBLE AS tax,
    sum(CAST(l_discount AS DECIMAL(18, 2)))::DOUBLE AS discount FROM lineitem GROUP BY 1) UNPIVOT t ON quantity, tax, discount INTO NAME measure VALUE total""")
def agg_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "tax", "discount"]
    sums = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.sum(exact(f"l_{n}")).cast("double").alias(n) for n in names])
    return sums.unpivot("l_returnflag", names, "measure", "total")


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
    round(quantile_cont(o_totalprice, 0.99), 4) AS q99 FROM orders GROUP BY 1""")
def agg_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_quantiles(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", [0.25, 0.5, 0.99])
    at = lambda q: F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 4)
    return got.groupBy("o_orderpriority").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.99).alias("q99"))


@query(named(SUBQUERIES.replace("{without}", NOT_IN), "orders", "customer", "lineitem"))
def join_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SUBQUERIES.replace("{without}", NOT_EXISTS), **{t: read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")})


@query(named(LATERAL, "nation", "supplier"))
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LATERAL, **{t: read(spark, sf_dir, t) for t in ("nation", "supplier")})


@query(named(TREE, "customer"))
def join_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own WITH RECURSIVE stops at a million rows; levels are written and joined one by one instead."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    edges = keys.where("k >= 4").select("k", F.floor(F.col("k") / 4.0).alias("parent"))
    levels = descend(keys.where("k < 4"), edges, "k", "parent", shared_folder(spark, "tree"))
    return levels.groupBy("depth").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("""SELECT n_name, count(s_suppkey) AS n_suppliers, coalesce(min(s_name), 'none') AS first_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "right").groupBy("n_name").agg(
        F.count("s_suppkey").alias("n_suppliers"), F.coalesce(F.min("s_name"), F.lit("none")).alias("first_name")
    )


@query("""WITH c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_name, s.c_mktsegment AS segment, coalesce(n, 0) AS n, (SELECT count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    WHERE a.n_regionkey = r_regionkey) AS nation_pairs FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
    LEFT JOIN c ON c.n_regionkey = r_regionkey AND c.c_mktsegment = s.c_mktsegment""")
def join_cross_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions by all segments, both a few rows; pairs of nations by an inequality beside the region's key."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    counts = customer.join(nation, customer.c_nationkey == nation.n_nationkey).groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    pairs = pairs.groupBy(F.col("a.n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nation_pairs"))
    all_pairs = region.crossJoin(customer.select(F.col("c_mktsegment").alias("segment")).distinct())
    return (
        all_pairs.join(counts, ["r_regionkey", "segment"], "left").join(pairs, "r_regionkey", "left")
        .na.fill(0, ["n", "nation_pairs"]).select("r_name", "segment", "n", "nation_pairs")
    )


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 9) AS part, round(cume_dist() OVER w, 9) AS below,
    lead(o_orderkey, 1, -1) OVER v AS following, first_value(o_orderkey) OVER v AS first, nth_value(o_orderkey, 2) OVER v AS second FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense"),
        F.round(F.percent_rank().over(w), 9).alias("part"),
        F.round(F.cume_dist().over(w), 9).alias("below"),
        F.lead("o_orderkey", 1, -1).over(v).alias("following"),
        F.first("o_orderkey").over(v).alias("first"),
        F.nth_value("o_orderkey", 2).over(v).alias("second"),
    )


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def window_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by user and type dropped, the earliest row kept: a grouped minimum, combined before the shuffle."""
    first = F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first)


@query("""SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders ORDER BY priority DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 25""")
def sort_nulls_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    return orders.orderBy(F.desc_nulls_last("priority"), "o_orderkey").offset(25).limit(50)


@query("""WITH l AS (SELECT l_suppkey AS k FROM lineitem), s AS (SELECT s_suppkey % 7 AS k FROM supplier)
    SELECT 'intersect all' AS form, k, count(*) AS n FROM (FROM l INTERSECT ALL FROM s) GROUP BY ALL UNION ALL SELECT 'except', k, count(*) FROM (FROM l EXCEPT FROM s) GROUP BY ALL
    UNION ALL SELECT 'except all', k, count(*) FROM (FROM s EXCEPT ALL FROM l) GROUP BY ALL UNION ALL SELECT 'union all', k, count(*) FROM (FROM l UNION ALL FROM s) GROUP BY ALL""")
def set_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"))
    b = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("k"))
    forms = {"intersect all": a.intersectAll(b), "except": a.subtract(b), "except all": b.exceptAll(a), "union all": a.unionAll(b)}
    out = None
    for form, df in forms.items():
        counted = df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(form).alias("form"), "k", "n")
        out = counted if out is None else out.unionAll(counted)
    return out


@query("""SELECT coalesce(kind, 'none') AS kind, count(*) AS n, count(balance) AS with_balance, count(price) AS with_price FROM
    (SELECT 'customer' AS kind, c_acctbal AS balance, NULL AS price FROM customer UNION ALL SELECT 'part', NULL, p_retailprice FROM part) GROUP BY 1""")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    b = read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"), F.lit("part").alias("kind"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("balance").alias("with_balance"), F.count("price").alias("with_price"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_orderkey // (o_custkey % 3))::BIGINT END AS share, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS level,
    try_cast(o_orderpriority AS INT) AS none, round(CAST(o_totalprice AS DECIMAL(18, 2)) / 7, 2)::DOUBLE AS seventh, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'in'
    WHEN o_orderpriority LIKE '%LOW' OR o_orderpriority ILIKE '%urgent%' THEN 'named' ELSE 'out' END AS band, o_orderstatus IN ('F', 'P') AS done FROM orders""")
def scalar_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by zero and casts that fail give null; decimals are rounded, so that engines agree."""
    priority = F.col("o_orderpriority")
    band = F.when(F.col("o_totalprice").between(1000, 50000), "in").when(priority.like("%LOW") | priority.ilike("%urgent%"), "named").otherwise("out")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("o_orderkey div nullif(o_custkey % 3, 0)").alias("share"),
        F.substring(priority, 1, 1).try_cast("int").alias("level"),
        priority.try_cast("int").alias("none"),
        F.round(exact("o_totalprice") / 7, 2).cast("double").alias("seventh"),
        band.alias("band"),
        F.col("o_orderstatus").isin("F", "P").alias("done"),
    )


@query("""SELECT p_partkey, len(string_split_regex(p_type, '[ ]+')) AS n_words, string_split_regex(p_type, '[ ]+')[1] AS first, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare,
    regexp_extract(p_brand, '([0-9]+)', 1) AS number, regexp_matches(p_name, 'e+') AS has_e, md5(concat_ws('|', p_brand, p_type)) AS digest, map_keys(MAP([p_brand, 'size'], [p_type, p_size::VARCHAR]))[1] AS key,
    MAP([p_brand, 'size'], [p_type, p_size::VARCHAR])['size'] AS size, list_sum(list_transform([p_size, p_size + 1, p_size * 2], lambda x: x % 10))::BIGINT AS digits FROM part""")
def scalar_regex_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", "[ ]+")
    pairs = F.map_from_arrays(F.array("p_brand", F.lit("size")), F.array(F.col("p_type"), F.col("p_size").cast("string")))
    sizes = F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") * 2)
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.size(words).cast("long").alias("n_words"),
        F.try_element_at(words, F.lit(1)).alias("first"),
        F.regexp_replace("p_name", "[aeiou]", "").alias("bare"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"),
        F.col("p_name").rlike("e+").alias("has_e"),
        F.md5(F.concat_ws("|", "p_brand", "p_type")).alias("digest"),
        F.map_keys(pairs)[0].alias("key"),
        F.try_element_at(pairs, F.lit("size")).alias("size"),
        F.aggregate(F.transform(sizes, lambda x: x % 10), F.lit(0).cast("long"), lambda a, x: a + x).alias("digits"),
    )


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.missing')::BIGINT AS missing, CAST(to_json({'type': event_type, 'k': json_extract(props, '$.k')::BIGINT}) AS VARCHAR) AS packed FROM events""")
def scalar_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-structured values read by path, and a struct written as JSON."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "bigint")
    return events.select("event_id", k.alias("k"), F.try_variant_get("v", "$.missing", "bigint").alias("missing"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("packed"))
