"""Queries of what other results are made into: hull polygons, source text, layout settings, sums over families, stored graph loci."""

from __future__ import annotations

from pyspark.sql import functions as F

from popspark.functions import spatial, vectors
from popspark.operators import layout, matrices, outcrossing, stages
from popspark.sources import store

from . import domain
from .domain import table
from .queries import FREQS, HULL, _laid_out, query, rounded


@query(f"WITH {HULL} SELECT stratum, 'POLYGON((' || string_agg(longitude || ' ' || latitude, ', ' ORDER BY corner) || ', ' || min(longitude || ' ' || latitude) FILTER (corner = 0) || '))' AS polygon FROM ring GROUP BY stratum", "points", recursive=True)
def hull_polygons(spark, d):
    return spatial.polygon_text(spatial.convex_hull(domain.points(spark, d), "stratum"), "stratum")


@query("WITH c AS (SELECT n_regionkey AS i, n_nationkey % 5 AS j, sum(n_nationkey)::DOUBLE AS v FROM nation GROUP BY ALL) SELECT 'matrix( c(' || string_agg(v::VARCHAR, ', ' ORDER BY i, j) || '), ncol=' || count(DISTINCT j) || ', nrow=' || count(DISTINCT i) || ', byrow=TRUE)' AS r FROM c")
def matrix_as_r(spark, d):
    n = table(spark, d, "nation")
    cells = n.groupBy(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 5).alias("j")).agg(F.sum("n_nationkey").cast("double").alias("value"))
    return matrices.r_source(cells)


@query("SELECT ((row_number() OVER (ORDER BY c_custkey) - 1) // 10)::INTEGER AS i, ((row_number() OVER (ORDER BY c_custkey) - 1) % 10)::INTEGER AS j, c_acctbal::DOUBLE AS value FROM customer")
def matrix_from_vector(spark, d):
    return matrices.from_vector(table(spark, d, "customer"), "c_custkey", "c_acctbal", 10)


@query("SELECT c_custkey, 1.0::DOUBLE AS norm, 8 AS n FROM customer")
def random_unit_norms(spark, d):
    v = table(spark, d, "customer").select("c_custkey", vectors.random_unit(8, 5).alias("v"))
    return v.select("c_custkey", F.round(vectors.magnitude(F.col("v")), 9).alias("norm"), F.size("v").alias("n"))


@query(
    f"WITH {FREQS}, m AS (SELECT a1, a2, p.p AS p1, q.p AS p2 FROM fam JOIN g_fam ON ind = mother JOIN f p USING (locus) JOIN f q USING (locus) WHERE p.allele = a1 AND q.allele = a2) SELECT round(sum(ln(CASE WHEN a1 = a2 THEN p1 * p1 * 0.25 + p1 * 0.75 ELSE 2 * p1 * p2 * 0.25 END)), 4) AS loglik FROM m", "g_msat", "fam", "g_fam",
)
def population_mother_loglik(spark, d):
    from popspark.operators import frequencies

    fam, _, g = domain.families(spark, d)
    f = frequencies.frequencies(domain.msat(spark, d)).groupBy("locus").agg(F.map_from_entries(F.collect_list(F.struct("allele", "p"))).alias("m"))
    f = f.select("locus", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda a: F.coalesce(F.try_element_at("m", a), F.lit(0.0))).alias("freqs"))
    hers = fam.join(g, fam["mother"] == g["ind"]).select("family", "locus", F.col("a1").alias("m1"), F.col("a2").alias("m2"), F.lit(2).alias("history")).join(F.broadcast(f), "locus")
    return rounded(outcrossing.population_log_likelihood(outcrossing.mother_log_likelihood(hers)), 4)


@query("SELECT n_nationkey AS id, round(500 * (1 - n_nationkey / 25::DOUBLE), 6) AS linear, round(least(500 * (1 - n_nationkey / 25::DOUBLE) + 200, 500), 6) AS reheated FROM nation")
def cooling_schedule(spark, d):
    cooled = layout.linear_cooling(500.0, F.col("n_nationkey"), 25)
    return rounded(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), cooled.alias("linear"), layout.reheated(cooled, layout.Configuration()).alias("reheated")))


@query("SELECT n_nationkey AS id, n_nationkey IN (0, 3) AS pinned, CASE n_nationkey WHEN 3 THEN 7.0 ELSE 10.0 END::DOUBLE AS px, CASE n_nationkey WHEN 3 THEN 8.0 ELSE 20.0 END::DOUBLE AS py FROM nation")
def layout_pinned(spark, d):
    return layout.pin(_laid_out(spark, d)[0], 3, 7.0, 8.0).select("id", "pinned", "px", "py")


@query("SELECT n_nationkey AS id, round((('0x' || substr(md5('4|x|' || n_nationkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) * 5, 9) AS vx, round((('0x' || substr(md5('4|y|' || n_nationkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) * 5, 9) AS vy, 0.0::DOUBLE AS vz FROM nation")
def layout_noise(spark, d):
    return rounded(layout.velocity_noise(_laid_out(spark, d)[0], 5.0, 4).select("id", "vx", "vy", "vz"), 9)


@query("SELECT edge_ord, round(least(1.0, weight) * 0.5, 6) AS stiffness FROM edges", "edges")
def edge_stiffness(spark, d):
    edges = domain.trade(spark, d)[1]
    return rounded(edges.select("edge_ord", layout.effective_stiffness(F.least(F.lit(1.0), "weight"), 0.5).alias("stiffness")))


@query("SELECT DISTINCT locus::INTEGER AS locus_ord, 'L' || locus AS name FROM g_msat WHERE locus % 2 = 1", "g_msat")
def stored_graph_loci(spark, d):
    loci = domain.msat(spark, d).select("locus").distinct()
    held = store.ProjectStore.create(spark, f"{stages.shared_folder(spark)}/store-{stages.unique()}", ("geneticData", "graph"))
    columns = [F.col("locus").alias("locus_ord"), F.concat(F.lit("L"), F.col("locus").cast("string")).alias("name"), F.lit("c").alias("contig"), F.col("locus").cast("long").alias("location"), F.lit("microsatellite").alias("marker_type"), F.lit("observed").alias("allele_provenance")]
    held.write_genetics(loci=loci.select(*columns))
    held.write_graph(graph_loci=loci.where("locus % 2 = 1").select(F.col("locus").alias("locus_ord")))
    return held.read_graph_loci().select("locus_ord", "name")
