"""Registered queries that read stored graphs, families and snapshots back, change staged tables and order them."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from popspark.functions.text import natural_key
from popspark.operators import simulation, tables
from popspark.sources import store

from . import domain
from .domain import table
from .imports import _place
from .lookups import _staged
from .queries import query


def _nodes(spark, d):
    n = table(spark, d, "nation")
    missing = F.lit(None).cast("double")
    return n.select(F.col("n_nationkey").cast("int").alias("node_ord"), F.concat(F.lit("node-"), F.col("n_name")).alias("id"), F.col("n_name").alias("name"), F.lit(1.0).alias("size"), missing.alias("latitude"), missing.alias("longitude"))


@query("SELECT 'edge-' || edge_ord AS id, 'node-' || a.n_name AS src, 'node-' || b.n_name AS dst, weight FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst", "edges")
def stored_graph_edges(spark, d):
    """A graph written and read back, its ends by the nodes' ids."""
    s = store.ProjectStore.open_or_create(spark, _place(spark), ("graph",))
    edges = domain.trade(spark, d)[1].select(F.col("edge_ord").cast("int").alias("edge_ord"), F.concat(F.lit("edge-"), F.col("edge_ord").cast("string")).alias("id"), F.col("src").cast("int").alias("from_ord"), F.col("dst").cast("int").alias("to_ord"), "weight")
    s.write_graph(nodes=_nodes(spark, d), edges=edges)
    return s.read_graph()[1].select("id", "src", "dst", "weight")


@query("SELECT 'm' || k AS name, (k + 1) * 3 - 1 AS ordinal, ((k + 1) * 3 - 1)::VARCHAR AS data FROM range(0, 1) t(k)")
def snapshot_newest_matrices(spark, d):
    """Of the matrices of one name a loaded snapshot holds the newest."""
    s = store.ProjectStore.open_or_create(spark, _place(spark), ("matrices",))
    for k in range(3):
        s.add_matrix("m0", str(k).encode(), datetime.datetime(2024, 1, 2))
    return s.load_snapshot()["matrices"]["matrices"].select("name", F.col("ordinal").cast("long").alias("ordinal"), F.col("data").cast("string").alias("data"))


@query("SELECT o_orderkey AS ind_ord, CASE WHEN o_orderkey % 5 = 0 THEN 'changed-' || o_orderkey ELSE 'order-' || o_orderkey END AS name FROM orders")
def individuals_updated(spark, d):
    people = _staged(spark, d)["individuals"]
    changes = people.where("ind_ord % 5 = 0").select("ind_ord", F.concat(F.lit("changed-"), F.col("ind_ord").cast("string")).alias("name"))
    unknown = spark.createDataFrame([(-1, "nobody")], "ind_ord long, name string")
    return store.update_rows(people, changes.unionByName(unknown), "ind_ord")


@query("SELECT DISTINCT l_linenumber AS locus_ord, 'locus ' || l_linenumber AS name FROM lineitem")
def loci_updated(spark, d):
    loci = _staged(spark, d)["loci"].select("locus_ord", "name")
    return store.update_rows(loci, loci.select("locus_ord", F.concat(F.lit("locus "), F.col("locus_ord").cast("string")).alias("name")), "locus_ord").withColumn("locus_ord", F.col("locus_ord").cast("int"))


@query("SELECT string_agg(name, ',' ORDER BY k) AS names FROM (SELECT 'NATION_' || n_nationkey AS name, n_nationkey AS k FROM nation)")
def strata_in_natural_order(spark, d):
    """Names in the order in which they come back, numbers by value."""
    names = table(spark, d, "nation").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"))
    placed = store.naturally(names).select(F.struct(natural_key(F.col("name")).alias("k"), "name").alias("x"))
    return placed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), ",").alias("names"))


@query("SELECT count(*) AS \"rows\", 6::INTEGER AS columns, 'number,category,date' AS kinds, 'date' AS x_kind FROM orders")
def role_frame_shape(spark, d):
    """Rows, columns, kinds of columns and of the x that is bound last."""
    frame = tables.RoleFrame(table(spark, d, "orders")).role("x", "o_totalprice").role("x", "o_orderdate")
    kinds = ",".join(frame.kind(c) for c in ("o_totalprice", "o_orderpriority", "o_orderdate"))
    return spark.createDataFrame([(frame.row_count(), len(frame.column_names), kinds, frame.x_kind)], "`rows` long, columns int, kinds string, x_kind string")


@query("SELECT 'f-' || o_custkey AS family_id, o_custkey::INTEGER AS family_order, o_orderkey::INTEGER AS offspring_ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS offspring_order FROM orders JOIN customer ON c_custkey = o_custkey")
def stored_parentage(spark, d):
    """Families (customers) and offspring (their orders) written and read back."""
    number = lambda w: F.row_number().over(w).cast("int")
    families = table(spark, d, "customer").select("c_custkey").select(F.concat(F.lit("f-"), F.col("c_custkey").cast("string")).alias("family_id"), F.col("c_custkey").cast("int").alias("family_order"), F.lit(None).cast("int").alias("mother_ord"))
    kids = table(spark, d, "orders").select(F.concat(F.lit("f-"), F.col("o_custkey").cast("string")).alias("family_id"), F.col("o_orderkey").cast("int").alias("offspring_ord"), number(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("offspring_order"))
    s = store.ProjectStore.open_or_create(spark, _place(spark), ("geneticData",))
    people = _staged(spark, d)["individuals"].select(F.col("ind_ord").cast("int").alias("ind_ord"), "name", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    s.write_genetics(individuals=people, families=families, family_offspring=kids)
    back, offspring = s.read_parentage()
    return offspring.join(back.select("family_id", "family_order"), "family_id").select("family_id", "family_order", "offspring_ord", "offspring_order")


@query("WITH p AS (SELECT o_orderkey AS ind, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), c AS (SELECT id, floor((('0x' || substr(md5('mates|m|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (SELECT max(n) FROM p)) AS mk, floor((('0x' || substr(md5('mates|f|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * (SELECT max(n) FROM p)) AS fk FROM range(0, 500) t(id)) SELECT 'offspring-' || id AS child, a.ind AS mother, b.ind AS father FROM c JOIN p a ON a.k = mk JOIN p b ON b.k = fk")
def random_crosses(spark, d):
    """The parents that random mating draws."""
    return simulation.random_crosses(table(spark, d, "orders").select(F.col("o_orderkey").alias("ind")), 500, "mates")
