"""Genotypes, families, graphs and points drawn from the driver's star schema.

Each view exists twice: as a DataFrame and as SQL text for the oracle. Both cover
whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Embedding components below -TAU, within, and above are dosages 0, 1 and 2.
TAU = 0.0555


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def msat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, locus, a1, a2: an order is an individual, a line number a locus."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("ind"), F.col("l_linenumber").alias("locus")).agg((F.min("l_partkey") % 6).cast("int").alias("a1"), (F.max("l_suppkey") % 6).cast("int").alias("a2"))


def order_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, stratum: the nation of each order's customer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("o_orderkey").alias("ind"), F.col("n_name").alias("stratum"))


def snp_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, locus, code: 0 missing, else dosage + 1, from the embeddings' components."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ind"), F.posexplode("embedding").alias("locus", "x"))
    code = F.when((F.col("ind") + F.col("locus")) % 11 == 0, 0).when(F.col("x") < -TAU, 1).when(F.col("x") < TAU, 2).otherwise(3)
    return e.select("ind", "locus", code.alias("code"))


def snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, locus, a1, a2 of the same."""
    code = F.col("code")
    a1 = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    a2 = F.when(code == 0, 0).when(code == 1, 1).otherwise(2)
    return snp_codes(spark, sf_dir).select("ind", "locus", a1.alias("a1"), a2.alias("a2"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ind, stratum: the embedding's label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ind"), F.concat(F.lit("pop-"), F.col("label").cast("string")).alias("stratum"))


def panel(spark: SparkSession, individuals: int = 1318, loci: int = 926) -> DataFrame:
    """ind, locus, a1, a2 of a made-up biallelic panel with about 11 % missing cells, at the size of the published baseline."""
    cells = spark.range(individuals * loci).select(F.floor(F.col("id") / loci).cast("int").alias("ind"), (F.col("id") % loci).cast("int").alias("locus"))
    draw = F.pmod(F.xxhash64("ind", "locus"), F.lit(100))
    a1 = F.when(draw < 11, 0).when(draw < 80, 1).otherwise(2)
    a2 = F.when(draw < 11, 0).when(draw < 50, 1).otherwise(2)
    return cells.select("ind", "locus", a1.alias("a1"), a2.alias("a2"))


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Families (customers; one in seven without a mother), offspring (their orders) and genotypes of both."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mother = F.when(F.col("c_custkey") % 7 != 0, -F.col("c_custkey"))
    fam = c.select(F.col("c_custkey").alias("family"), mother.alias("mother"))
    kids = o.select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("offspring"), F.col("o_orderkey").alias("place"))
    loci = msat(spark, sf_dir).select("locus").distinct()
    hers = fam.where("mother is not null").crossJoin(F.broadcast(loci))
    hers = hers.select(F.col("mother").alias("ind"), "locus", ((F.col("family") + F.col("locus")) % 5 + 1).cast("int").alias("a1"), ((F.col("family") * F.col("locus")) % 5 + 1).cast("int").alias("a2"))
    return fam, kids, msat(spark, sf_dir).unionByName(hers)


def trade(spark: SparkSession, sf_dir: str, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes (nations) and edges: each customer nation to the k supplier nations that it buys most from; dearer trade is nearer."""
    li, o, c, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    flow = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
    sums = flow.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("revenue"), "dst"))).where(F.col("k") <= k)
    nodes = n.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"))
    return nodes, top.select((F.col("src") * 100 + F.col("k")).cast("long").alias("edge_ord"), "src", "dst", F.round(F.lit(1e7) / F.col("revenue"), 6).alias("weight"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, latitude, longitude, stratum: customers at places hashed from their key."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    lon = ((F.col("c_custkey") * 7919) % 36000) / 100.0 - 180.0
    lat = ((F.col("c_custkey") * 104729) % 16000) / 100.0 - 80.0
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), lat.alias("latitude"), lon.alias("longitude"), F.col("n_name").alias("stratum"))


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, latitude, longitude of nations."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ((k * 53) % 160 - 80.0).alias("latitude"), ((k * 37) % 360 - 180.0).alias("longitude"))


VIEWS = {
    "g_msat": "SELECT l_orderkey AS ind, l_linenumber AS locus, CAST(min(l_partkey) % 6 AS INTEGER) AS a1, CAST(max(l_suppkey) % 6 AS INTEGER) AS a2 FROM lineitem GROUP BY ALL",
    "order_nation": "SELECT o_orderkey AS ind, n_name AS stratum FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "snp_codes": f"SELECT ind, locus, CASE WHEN (ind + locus) % 11 = 0 THEN 0 WHEN x < -{TAU} THEN 1 WHEN x < {TAU} THEN 2 ELSE 3 END AS code FROM (SELECT vec_id AS ind, unnest(range(len(embedding)))::INTEGER AS locus, unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "g_snp": "SELECT ind, locus, CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS a1, CASE code WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS a2 FROM snp_codes",
    "labels_of": "SELECT vec_id AS ind, 'pop-' || label AS stratum FROM embeddings",
    "fam": "SELECT c_custkey AS family, CASE WHEN c_custkey % 7 <> 0 THEN -c_custkey END AS mother FROM customer",
    "kids": "SELECT o_custkey AS family, o_orderkey AS offspring, o_orderkey AS place FROM orders",
    "g_fam": "SELECT * FROM g_msat UNION ALL SELECT mother AS ind, locus, CAST((family + locus) % 5 + 1 AS INTEGER) AS a1, CAST((family * locus) % 5 + 1 AS INTEGER) AS a2 FROM fam, (SELECT DISTINCT locus FROM g_msat) WHERE mother IS NOT NULL",
    "edges": "SELECT src * 100 + k AS edge_ord, src, dst, round(1e7 / revenue, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY revenue DESC, dst) AS k FROM (SELECT c_nationkey AS src, s_nationkey AS dst, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)) WHERE k <= 4",
    "points": "SELECT c_custkey AS id, ((c_custkey * 104729) % 16000) / 100.0::DOUBLE - 80.0 AS latitude, ((c_custkey * 7919) % 36000) / 100.0::DOUBLE - 180.0 AS longitude, n_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "nation_points": "SELECT n_name AS name, (n_nationkey * 53) % 160 - 80.0::DOUBLE AS latitude, (n_nationkey * 37) % 360 - 180.0::DOUBLE AS longitude FROM nation",
}
NEEDS = {"g_snp": ["snp_codes"], "g_fam": ["g_msat", "fam"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """sql after the common table expressions it names and those that they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    if not order:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
