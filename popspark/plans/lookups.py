"""Further registered queries: gathers, lookups, joins of the staging tables, scalars, exports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.functions import spatial, text, vectors
from popspark.operators import distance, frequencies, genotype_bits, graphs, layout, matrices, outcrossing, parentage, resampling, stages, statistics
from popspark.sources import exporters, store
from popspark.streaming import frequencies as streaming

from . import domain
from .domain import table
from .queries import FAMILY_VIEWS, FREQS, HAVERSINE, LAYOUT, LONG, RESCALED, VEC, _laid_out, _long, query, rounded

# Staging tables: individuals are orders, loci are line numbers, strata are nations.


def _staged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    g = domain.msat(spark, d).withColumnsRenamed({"ind": "ind_ord", "locus": "locus_ord"})
    people = table(spark, d, "orders").select(F.col("o_orderkey").alias("ind_ord"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"))
    strata = domain.order_nation(spark, d).select(F.col("ind").alias("ind_ord"), F.lit("nation").alias("level"), F.col("stratum").alias("stratum_name"))
    loci = g.select("locus_ord").distinct().select("locus_ord", F.concat(F.lit("L"), F.col("locus_ord").cast("string")).alias("name"), F.concat(F.lit("chr"), (F.col("locus_ord") % 3 * 5).cast("string")).alias("contig"), (F.col("locus_ord") * 10).cast("long").alias("location"), F.when(F.col("locus_ord") % 2 == 0, "biallelicSNP").otherwise("microsatellite").alias("marker_type"))
    return {"genotypes": g, "individuals": people, "strata": strata, "loci": loci}


@query("SELECT o_orderkey AS ind_ord, 'order-' || o_orderkey AS name FROM orders SEMI JOIN order_nation ON ind = o_orderkey AND stratum = 'NATION_3'", "order_nation")
def stratum_members(spark, d):
    t = _staged(spark, d)
    return store.members(t["individuals"], t["strata"], "nation", "NATION_3")


@query("SELECT g.ind AS ind_ord, g.locus AS locus_ord, a1, a2 FROM g_msat g SEMI JOIN order_nation n ON n.ind = g.ind AND stratum = 'NATION_3' WHERE locus = 2 AND (a1 <> 0 OR a2 <> 0)", "g_msat", "order_nation")
def stratum_genotypes_at_locus(spark, d):
    t = _staged(spark, d)
    return store.genotypes_in(t["genotypes"], t["strata"], "nation", "NATION_3", 2)


@query("SELECT o_orderkey AS ind_ord, coalesce(a1, 0) AS a1, coalesce(a2, 0) AS a2 FROM orders LEFT JOIN g_msat ON ind = o_orderkey AND locus = 7", "g_msat")
def genotypes_at_locus(spark, d):
    t = _staged(spark, d)
    return store.genotypes_at(t["individuals"], t["genotypes"], 7)


@query("SELECT DISTINCT 'L' || locus AS name FROM g_msat WHERE a1 <> 0 OR a2 <> 0", "g_msat")
def locus_names(spark, d):
    t = _staged(spark, d)
    return store.locus_names(t["genotypes"], t["loci"])


@query("SELECT CASE WHEN ind > 5 THEN ind - 1 ELSE ind END AS ind_ord, locus AS locus_ord, a1, a2 FROM g_msat WHERE ind <> 5", "g_msat")
def genotypes_without_one(spark, d):
    t = _staged(spark, d)
    return store.delete_individual(t["individuals"], t["genotypes"], 5)[1]


@query("SELECT g.ind AS ind_ord, g.locus AS locus_ord, CASE WHEN locus % 2 = 0 AND (a1 = 0 OR a2 = 0) THEN 0 ELSE a1 END AS a1, CASE WHEN locus % 2 = 0 AND (a1 = 0 OR a2 = 0) THEN 0 ELSE a2 END AS a2 FROM g_msat g", "g_msat")
def markers_for_matrix(spark, d):
    t = _staged(spark, d)
    out = store.markers_for_matrix(t["genotypes"], t["loci"])
    return out.select("ind_ord", "locus_ord", F.col("a1").cast("int").alias("a1"), F.col("a2").cast("int").alias("a2"))


@query("SELECT DISTINCT locus::INTEGER AS locus_ord, dense_rank() OVER (ORDER BY (locus % 3) * 5, locus) AS rank FROM g_msat", "g_msat")
def loci_in_order(spark, d):
    loci = _staged(spark, d)["loci"]
    return store.loci_ranked(loci).select("locus_ord", "rank")


@query(
    "SELECT stratum AS Population, 'order-' || o_orderkey AS Individual, " + ", ".join(f"coalesce(max(a1 || ':' || a2) FILTER (locus = {k}), ':') AS L{k}" for k in range(1, 8)) + " FROM orders JOIN order_nation n ON n.ind = o_orderkey LEFT JOIN (SELECT ind, locus, CASE a1 WHEN 0 THEN '' ELSE a1::VARCHAR END AS a1, CASE a2 WHEN 0 THEN '' ELSE a2::VARCHAR END AS a2 FROM g_msat) g ON g.ind = o_orderkey GROUP BY ALL", "g_msat", "order_nation",
)
def genotype_export_rows(spark, d):
    t = _staged(spark, d)
    label = lambda c: F.when(F.col(c) == 0, "").otherwise(F.col(c).cast("string"))
    labelled = t["genotypes"].select(F.col("ind_ord").alias("ind"), F.concat(F.lit("L"), F.col("locus_ord").cast("string")).alias("locus"), label("a1").alias("left"), label("a2").alias("right"))
    people = t["individuals"].withColumnRenamed("ind_ord", "ind")
    return exporters.genotype_rows(labelled, people, domain.order_nation(spark, d), [f"L{k}" for k in range(1, 8)])


@query("SELECT locus, '| ' || string_agg(printf('%.4f', p), ' | ' ORDER BY allele) || ' |' AS \"row\" FROM (" + f"WITH {FREQS} SELECT * FROM f" + ") GROUP BY locus", "g_msat")
def markdown_frequency_row(spark, d):
    return frequencies.markdown_rows(frequencies.frequencies(domain.msat(spark, d)))


# Matrices and triangles.


@query(f"WITH {LONG}, r AS (SELECT * FROM (VALUES (0, 3), (1, 3), (2, 99)) v(x, i)), c AS (SELECT * FROM (VALUES (0, 12), (1, 1)) v(y, j)) SELECT x::INTEGER AS i, y::INTEGER AS j, value FROM r CROSS JOIN c JOIN m USING (i, j)")
def matrix_gather(spark, d):
    rows = spark.createDataFrame([(0, 3), (1, 3), (2, 99)], "at int, i int")
    cols = spark.createDataFrame([(0, 12), (1, 1)], "at int, j int")
    return matrices.gather(_long(spark, d), rows, cols).where(~F.isnan("value"))


@query(f"WITH {LONG} SELECT i, list(value ORDER BY j) AS \"row\" FROM m GROUP BY i")
def matrix_rows(spark, d):
    return matrices.to_arrays(_long(spark, d)).select("i", "row")


@query(f"WITH {LONG}, s AS (SELECT i, sum(value) AS s FROM m GROUP BY i) SELECT i, j, round(s, 6) AS value FROM m JOIN s USING (i)")
def matrix_row_totals(spark, d):
    return rounded(matrices.row_matrix(_long(spark, d)))


@query(f"WITH {LONG} SELECT i, j, round(value * 2.5, 8) AS times, round(value / 4, 8) AS over, round(value - 1, 8) AS minus FROM m")
def matrix_scalars(spark, d):
    m = _long(spark, d)
    parts = [matrices.scalar(m, op, s).withColumnRenamed("value", n) for op, s, n in (("*", 2.5, "times"), ("/", 4, "over"), ("-", 1, "minus"))]
    return rounded(parts[0].join(parts[1], ["i", "j"]).join(parts[2], ["i", "j"]), 8)


@query(f"WITH {LONG}, v AS (SELECT j AS i, value AS w FROM m WHERE i = 1) SELECT m.i, round(sum(value * w), 2) AS value FROM m JOIN v ON m.j = v.i GROUP BY ALL")
def matrix_vector_product(spark, d):
    m = _long(spark, d)
    return rounded(matrices.multiply_vector(m, matrices.transpose(m).where("j = 1").select("i", "value")), 2)


TRI = f"e AS ({VEC}), t AS (SELECT a.i, b.i AS j, round(list_distance(a.v, b.v), 6) AS value FROM e a JOIN e b ON a.i < b.i)"


def _triangle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return matrices.row_distances(e, "vec_id", "v", upper=True, digits=6)


@query(f"WITH {TRI} SELECT i, j, value FROM t UNION ALL SELECT j, i, value FROM t UNION ALL SELECT i, i, 0.0::DOUBLE FROM e")
def triangle_dense(spark, d):
    return matrices.dense(_triangle(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("i")))


@query(f"WITH {TRI}, x AS (SELECT i AS old, row_number() OVER (ORDER BY i DESC) - 1 AS pos FROM e) SELECT least(a.pos, b.pos) AS i, greatest(a.pos, b.pos) AS j, value FROM t JOIN x a ON a.old = t.i JOIN x b ON b.old = t.j")
def triangle_gather(spark, d):
    index = stages.numbered(table(spark, d, "embeddings").select("vec_id"), [F.desc("vec_id")], "at").select("at", F.col("vec_id").alias("i"))
    return matrices.triangle_gather(_triangle(spark, d), index)


@query(
    "WITH l AS (SELECT x.ind AS i, y.ind AS j, x.locus, ((x.a1 = 2)::INT + (x.a2 = 2)::INT - (y.a1 = 2)::INT - (y.a2 = 2)::INT) ** 2 AS d FROM g_snp x JOIN g_snp y ON x.locus = y.locus AND x.ind < y.ind WHERE x.a1 <> 0 AND y.a1 <> 0) SELECT i, j, sum(d) FILTER (locus < 32) AS first, coalesce(sum(d) FILTER (locus < 32), 0) + coalesce(sum(d) FILTER (locus >= 32), 0) AS added, coalesce(sum(d) FILTER (locus < 32), 0) - coalesce(sum(d) FILTER (locus >= 32), 0) AS taken FROM l GROUP BY ALL HAVING first IS NOT NULL", "g_snp",
)
def triangle_add_subtract(spark, d):
    both = genotype_bits.pair_sums(domain.snp(spark, d), classes=F.when(F.col("locus") < 32, 0).otherwise(1), kinds=2)
    a, b = (F.when(F.col(f"c{k}") > 0, F.col(f"s{k}")) for k in (0, 1))
    return both.where("c0 > 0").select("i", "j", a.alias("first"), matrices.added(a, b).alias("added"), matrices.added(a, b, -1).alias("taken"))


@query("SELECT x.ind AS i, y.ind AS j, sum(((x.a1 = 2)::INT + (x.a2 = 2)::INT - (y.a1 = 2)::INT - (y.a2 = 2)::INT) ** 2) AS d2, count(*) AS covered FROM g_snp x JOIN g_snp y ON x.locus = y.locus AND x.ind < y.ind WHERE x.a1 <> 0 AND y.a1 <> 0 GROUP BY ALL", "g_snp")
def locus_distance_and_coverage(spark, d):
    return genotype_bits.pair_sums(domain.snp(spark, d)).where("c > 0").select("i", "j", F.col("s").alias("d2"), F.col("c").alias("covered"))


@query(f"WITH {RESCALED} SELECT least(a.stratum, b.stratum) AS g, greatest(a.stratum, b.stratum) AS h, round(sum(d2), 4) AS s FROM dist JOIN labels_of a ON a.ind = i JOIN labels_of b ON b.ind = j GROUP BY ALL", "g_snp", "labels_of")
def stratum_pair_sums(spark, d):
    return rounded(distance.genetic_pair_sums(domain.snp(spark, d), domain.labels(spark, d)), 4)


# Vectors.


@query(f"WITH e AS ({VEC}) SELECT a.i, list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2])) AS smaller, list_transform(list_zip(a.v, b.v), lambda z: round(z[1] + z[2], 9)) AS added, list_transform(a.v, lambda x: sign(x) * least(0.05, abs(x))) AS limited, [a.v[1], a.v[2], a.v[3]] AS p3, a.v = b.v AS same FROM e a JOIN e b ON b.i = (a.i + 1) % (SELECT count(*) FROM e)")
def vector_pairs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg(F.count("*").alias("n"))
    other = e.select(F.col("i").alias("k"), F.col("v").alias("w"))
    pairs = e.crossJoin(F.broadcast(n)).withColumn("k", (F.col("i") + 1) % F.col("n")).join(other, "k")
    v, w = F.col("v"), F.col("w")
    return pairs.select("i", vectors.smallest(v, w).alias("smaller"), F.transform(vectors.elementwise(v, "+", w), lambda x: F.round(x, 9)).alias("added"), vectors.limit_magnitude(v, 0.05).alias("limited"), vectors.point(v, 3).alias("p3"), vectors.equal(v, w).alias("same"))


@query("SELECT vec_id AS i, (('0x' || substr(md5('seed|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS draw FROM embeddings")
def seeded_draws(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), vectors.hashed_unit("seed", F.col("vec_id")).alias("draw"))


# Models, resampling, parentage.


@query("WITH e AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), c AS (SELECT * FROM (VALUES (0, -0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.1, 0.0), (2, 0.0, -0.1, 0.0)) v(cluster, a, b, c)) SELECT id, cluster::INTEGER AS cluster, round((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, 9) AS d2 FROM e, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, cluster) = 1")
def closest_cluster(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    centers = spark.createDataFrame([(0, -0.1, 0.0, 0.1), (1, 0.1, 0.1, 0.0), (2, 0.0, -0.1, 0.0)], "cluster int, cx double, cy double, cz double")
    return rounded(statistics.closest(points, centers).select("id", "cluster", "d2"), 9)


@query("WITH v AS (SELECT c_custkey AS iter, c_acctbal AS value FROM customer) SELECT iter, value, round((count(*) FILTER (value >= 5000) OVER w + 1) / (count(*) OVER w + 1), 9) AS p_value FROM v WINDOW w AS (ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_p_value(spark, d):
    null = table(spark, d, "customer").select(F.col("c_custkey").alias("iter"), F.col("c_acctbal").alias("value"))
    out = resampling.running_p_value(null, 5000.0)
    return out.select("iter", "value", F.round("p_value", 9).alias("p_value"))


@query("SELECT locus, allele, n, round(n / sum(n) OVER (PARTITION BY locus), 6) AS p FROM (SELECT locus, allele, count(*) AS n FROM (SELECT locus, unnest([a1, a2]) AS allele FROM g_fam SEMI JOIN fam ON mother = ind) WHERE allele <> 0 GROUP BY ALL)", *FAMILY_VIEWS)
def adult_frequencies(spark, d):
    fam, _, g = domain.families(spark, d)
    return rounded(frequencies.adult_frequencies(g, fam))


@query("SELECT o_custkey AS family, count(*) AS n FROM orders SEMI JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def offspring_per_family(spark, d):
    fam, kids, _ = domain.families(spark, d)
    return parentage.offspring_of(kids, fam).groupBy("family").agg(F.count("*").alias("n"))


@query("SELECT k::INTEGER AS history, CASE WHEN k >= 6 THEN 1.0::DOUBLE ELSE 1 - 0.5::DOUBLE ** k END AS f FROM range(0, 9) r(k)")
def inbreeding_by_history(spark, d):
    return spark.range(9).select(F.col("id").cast("int").alias("history")).withColumn("f", outcrossing.inbreeding_coefficient(F.col("history")))


# Graphs and layout.


@query("SELECT edge_ord, src, dst, weight, a.n_name AS src_name, b.n_name AS dst_name FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst", "edges")
def edge_ends(spark, d):
    nodes, edges = domain.trade(spark, d)
    return graphs.ends(edges, nodes).select("edge_ord", "src", "dst", "weight", "src_name", "dst_name")


@query(f"WITH e AS ({VEC}) SELECT a.i * 3 + row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) AS edge_ord, a.i AS src, b.i AS dst, round(list_distance(a.v, b.v), 6) AS weight FROM e a JOIN e b ON a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) <= 3")
def knn_graph(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(graphs.knn_edges(e, "vec_id", "v", 3))


@query(f"WITH {LAYOUT} SELECT round(least(1000 * 0.9 / (max(x) - min(x)), 800 * 0.9 / (max(y) - min(y)), 5.0), 6) AS zoom, round(-(min(x) + max(x)) / 2 * least(1000 * 0.9 / (max(x) - min(x)), 800 * 0.9 / (max(y) - min(y)), 5.0), 4) AS pan_x, round(-(min(y) + max(y)) / 2 * least(1000 * 0.9 / (max(x) - min(x)), 800 * 0.9 / (max(y) - min(y)), 5.0), 4) AS pan_y FROM nd", "edges")
def layout_fit(spark, d):
    out = layout.fit_to_view(_laid_out(spark, d)[0], (1000.0, 800.0))
    return out.select(F.round("zoom", 6).alias("zoom"), F.round("pan_x", 4).alias("pan_x"), F.round("pan_y", 4).alias("pan_y"))


@query(f"WITH {LAYOUT} SELECT round(sum(sqrt(fx * fx + fy * fy)), 3) AS total, round(avg(sqrt(fx * fx + fy * fy)), 3) AS average FROM (SELECT -0.5 * x + coalesce(rp.fx, 0) + coalesce(sp.fx, 0) AS fx, -0.5 * y + coalesce(rp.fy, 0) + coalesce(sp.fy, 0) AS fy FROM nd LEFT JOIN rp USING (id) LEFT JOIN sp ON sp.id = nd.id)", "edges")
def layout_energy(spark, d):
    nodes, edges = _laid_out(spark, d)
    return rounded(layout.total_energy(layout.forces(nodes, edges, layout.Configuration())), 3)


# Places, text, streams.


@query(f"SELECT a.name AS source, b.name AS target, round({HAVERSINE.format(a='a', b='b')}, 4) AS km FROM nation_points a, nation_points b", "nation_points")
def physical_distance(spark, d):
    return rounded(spatial.physical_distance(domain.nation_points(spark, d), "name"), 4)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_scalars(spark, d):
    return table(spark, d, "events").select("event_id", text.json_scalar(F.col("props"), "$.k").alias("k"))


@query("SELECT c_custkey, round(('0x' || substr(h, 1, 2))::INT / 255.0::DOUBLE, 9) AS red, round(('0x' || substr(h, 3, 2))::INT / 255.0::DOUBLE, 9) AS green, round(('0x' || substr(h, 5, 2))::INT / 255.0::DOUBLE, 9) AS blue FROM (SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 6) AS h FROM customer)")
def hex_colours(spark, d):
    c = table(spark, d, "customer").select("c_custkey", text.hex_colour(F.concat(F.lit("#"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6))).alias("c"))
    return rounded(c.select("c_custkey", "c.*"), 9)


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders")
def month_day_year(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.date_format("o_orderdate", "MM/dd/yyyy"))
    return o.select("o_orderkey", text.month_day_year(F.col("s")).cast("timestamp_ntz").alias("day"))


@query("SELECT locus, allele, n::BIGINT AS n FROM (SELECT locus, allele, count(*) AS n FROM (SELECT dayofweek(ts)::INTEGER AS locus, unnest([(user_id % 5)::INTEGER, (event_id % 4)::INTEGER]) AS allele FROM events) WHERE allele <> 0 GROUP BY ALL)")
def streamed_allele_counts(spark, d):
    """The streaming counter, run over the events as one available-now stream into memory."""
    import uuid

    from popspark.operators.stages import saved

    events = table(spark, d, "events").select("ts", (F.dayofweek("ts") - 1).alias("locus"), (F.col("user_id") % 5).cast("int").alias("a1"), (F.col("event_id") % 4).cast("int").alias("a2"), F.lit(1).alias("sign"))
    held = saved(events, "stream")
    path = held.inputFiles()[0].rsplit("/", 1)[0]
    name = f"counts_{uuid.uuid4().hex}"
    q = streaming.running_counts(spark.readStream.schema(held.schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query()
def panel_distance_1318x926(spark, d):
    """All pairwise distances of a panel of the baseline's size: 868 thousand pairs, 804 million scored terms at most."""
    return distance.genetic_distance(domain.panel(spark))
