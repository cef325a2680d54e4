"""Registered queries of importers, exporters, the store, and remaining scalars.

The driver's tables are first written as the files that an importer reads (one file,
as those formats are), under the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popspark.functions import spatial, text, vectors
from popspark.operators import distance, frequencies, graphs, layout, matrices, resampling, stages, statistics, tables
from popspark.sources import importers, store

from . import domain
from .domain import table
from .queries import LAYOUT, LONG, MATERIALISED, PERMUTATIONS, VEC, _laid_out, _long, query, relabel, rounded


def _place(spark: SparkSession) -> str:
    stages.saved(spark.range(0), "files")  # sets the shared folder in a local session
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/files-{uuid.uuid4().hex}"


def _file(lines: DataFrame, path: str) -> str:
    """lines (at, line) in order, in as many files as there are ranges."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(path)
    return path


def _headed(header: str, rows: DataFrame, key: str, line: Column) -> DataFrame:
    spark = rows.sparkSession
    return spark.createDataFrame([(-1, header)], "at long, line string").unionByName(rows.select(F.col(key).cast("long").alias("at"), line.alias("line")))


@query(
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ind, * FROM orders) SELECT ind::INTEGER AS ind, 'Prio' AS locus, substr(o_orderpriority, 1, 1) AS \"left\", o_orderstatus AS \"right\" FROM o UNION ALL SELECT ind::INTEGER, 'Status', CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, '' FROM o"
)
def import_population_csv(spark, d):
    o = table(spark, d, "orders")
    line = F.concat_ws(",", F.lit("N"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat_ws(":", F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")))
    path = _file(_headed("Region,ID,Prio,Status", o, "o_orderkey", line), _place(spark))
    data = importers.import_population_table(spark, path, importers.PopulationLayout(("Region",), "ID"))
    names = data.loci.select(F.col("locus_ord").alias("locus"), "name")
    return frequencies.decode(data.genotypes, data.codebooks).join(F.broadcast(names), "locus").select("ind", F.col("name").alias("locus"), "left", "right")


@query(
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ind, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey::VARCHAR AS family, row_number() OVER (ORDER BY min(ind)) - 1 AS family_order, (min(ind) FILTER (k = 1))::INTEGER AS mother FROM o GROUP BY o_custkey"
)
def import_family_csv(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").withColumn("k", k)
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("k").cast("string"), F.concat_ws(":", F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")))
    path = _file(_headed("momID,OffspringID,L", o, "o_orderkey", line), _place(spark))
    return importers.import_family_table(spark, path).families.withColumn("family_order", F.col("family_order").cast("long"))


@query("SELECT ind::INTEGER AS ind, locus, a1, a2 FROM g_snp", "g_snp")
def import_dosage_triplet(spark, d):
    codes = domain.snp_codes(spark, d)
    path = _place(spark)
    rows = codes.groupBy("ind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locus", "code"))), lambda s: (s["code"] - 1).cast("string")), "\t").alias("dosages"))
    _file(rows.select(F.col("ind").alias("at"), F.concat_ws("\t", F.col("ind").cast("string"), "dosages").alias("line")), path)
    _file(rows.select(F.col("ind").alias("at"), F.concat(F.lit("i"), F.col("ind").cast("string")).alias("line")), f"{path}.indv")
    _file(codes.select("locus").distinct().select(F.col("locus").alias("at"), F.concat_ws("\t", F.lit("c1"), F.col("locus").cast("string")).alias("line")), f"{path}.pos")
    return importers.import_dosage_triplet(spark, path).genotypes


EDGES_BOTH = "WITH e AS (SELECT a.n_name AS a, b.n_name AS b, weight, row_number() OVER (ORDER BY edge_ord) - 1 AS k FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst) SELECT (2 * k)::INTEGER AS edge_ord, a AS src, b AS dst, weight FROM e UNION ALL SELECT (2 * k + 1)::INTEGER, b, a, weight FROM e"


@query(EDGES_BOTH, "edges")
def import_graph_text(spark, d):
    nodes, edges = domain.trade(spark, d)
    edges = stages.saved(graphs.ends(edges, nodes), "trade")
    n, m = nodes.count(), edges.count()
    head = spark.createDataFrame([(-1, f"{n} {m}")], "at long, line string")
    lines = nodes.select(F.col("ordinal").cast("long").alias("at"), F.concat_ws(" ", "name", F.lit("1.0"), F.lit("g")).alias("line"))
    arcs = edges.select((F.col("edge_ord") + 1000).alias("at"), F.concat_ws("\t", "src_name", "dst_name", F.col("weight").cast("string")).alias("line"))
    return importers.import_graph_text(spark, _file(head.unionByName(lines).unionByName(arcs), _place(spark)))[1]


@query("SELECT name AS id, 2.0::DOUBLE AS size, longitude, latitude, 7.5::DOUBLE AS area, 'east' AS side FROM nation_points", "nation_points")
def import_geojson(spark, d):
    p = domain.nation_points(spark, d)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct("name", F.lit(2).alias("size"), F.lit(7.5).alias("area"), F.lit("east").alias("side")).alias("properties"))
    doc = p.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("line")).withColumn("at", F.lit(0))
    n = importers.import_geojson(spark, _file(doc, _place(spark)))[0]
    return n.select("id", "size", "longitude", "latitude", F.col("continuous")["area"].alias("area"), F.col("categorical")["side"].alias("side"))


@query("SELECT (SELECT count(*) FROM orders) AS individuals, 7::BIGINT AS loci, 'mixed' AS markers, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM g_msat) AS genotypes", "g_msat", "edges")
def project_store_summary(spark, d):
    from .lookups import _staged

    t = _staged(spark, d)
    s = store.ProjectStore.create(spark, _place(spark))
    people = t["individuals"].withColumn("latitude", F.lit(None)).withColumn("longitude", F.lit(None))
    s.write_genetics(individuals=people, loci=t["loci"].withColumn("allele_provenance", F.lit("observed")), genotypes=t["genotypes"])
    nodes, edges = domain.trade(spark, d)
    nodes = nodes.select(F.col("ordinal").alias("node_ord"), F.col("id").cast("string").alias("id"), "name", F.lit(1.0).alias("size"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    s.write_graph(nodes=nodes, edges=edges.select("edge_ord", F.col("edge_ord").cast("string").alias("id"), F.col("src").alias("from_ord"), F.col("dst").alias("to_ord"), "weight"))
    got = s.summary()
    genotypes = s.read_genetics()["genotypes"].agg(F.count("*").alias("genotypes"))
    return genotypes.select(F.lit(got.individuals).cast("long").alias("individuals"), F.lit(got.loci).cast("long").alias("loci"), F.lit(got.markers).alias("markers"), F.lit(got.nodes).cast("long").alias("nodes"), F.lit(got.edges).cast("long").alias("edges"), "genotypes")


@query("SELECT event_type AS name, max_by(event_id::VARCHAR, event_id) AS data FROM events GROUP BY event_type")
def latest_matrix(spark, d):
    s = store.ProjectStore.create(spark, _place(spark), ("matrices",))
    e = table(spark, d, "events")
    s.write("matrices", {"matrices": e.select(F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.lit(None).alias("description"), F.col("ts").cast("timestamp").alias("created_at"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("data"))})
    return s.latest_matrix().select("name", F.decode("data", "UTF-8").alias("data"))


@query(f"WITH e AS ({VEC}) SELECT i, [round(x + 1, 9) FOR x IN v] AS plus, [round(x - 1, 9) FOR x IN v] AS minus, [round(x * 2, 9) FOR x IN v] AS times, [round(x / 2, 9) FOR x IN v] AS over, round(list_inner_product(v, v) / 2, 6) AS half FROM e")
def vector_scalars(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    r = lambda c: F.transform(c, lambda x: F.round(x, 9))
    v = F.col("v")
    return e.select("i", r(vectors.scalar(v, "+", 1)).alias("plus"), r(vectors.scalar(v, "-", 1)).alias("minus"), r(vectors.scalar(v, "*", 2)).alias("times"), r(vectors.scalar(v, "/", 2)).alias("over"), F.round(vectors.half_squared_distance(v, vectors.zeros(F.size(v))), 6).alias("half"))


@query(f"WITH e AS ({VEC}) SELECT i, 'c(' || array_to_string([printf('%.1f', floor(x * 1000) + 0.5) FOR x IN v], ', ') || ')' AS source FROM e")
def vector_as_r(spark, d):
    half = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double") + 0.5)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), vectors.r_vector(half).alias("source"))


@query(f"WITH {LAYOUT} SELECT id, round(x * 1.5 + 10 + 400, 6) AS view_x, round(y * 1.5 - 20 + 300, 6) AS view_y FROM nd", "edges")
def layout_in_view(spark, d):
    at = layout.world_to_view(F.col("x"), F.col("y"), 1.5, (10.0, -20.0), (800.0, 600.0))
    return rounded(_laid_out(spark, d)[0].select("id", at.alias("v")).select("id", F.col("v.x").alias("view_x"), F.col("v.y").alias("view_y")))


@query(f"WITH {LAYOUT} SELECT id, id AS ordinal FROM nd WHERE (x - 100) ** 2 + (y - 100) ** 2 <= 160 ** 2 ORDER BY id LIMIT 1", "edges")
def layout_hit(spark, d):
    nodes = _laid_out(spark, d)[0].withColumn("radius", F.lit(160.0))
    return layout.hit(nodes, (100.0, 100.0), 1.0, (0.0, 0.0), (0.0, 0.0))


@query(
    f"WITH {LAYOUT}, w AS (SELECT id, 0.5 * (250 - x) + CASE WHEN x < 50 THEN 1000 / greatest(0.1, x) ** 2 ELSE 0 END - CASE WHEN x > 450 THEN 1000 / greatest(0.1, 500 - x) ** 2 ELSE 0 END AS fx, 0.5 * (250 - y) + CASE WHEN y < 50 THEN 1000 / greatest(0.1, y) ** 2 ELSE 0 END - CASE WHEN y > 450 THEN 1000 / greatest(0.1, 500 - y) ** 2 ELSE 0 END AS fy FROM nd) SELECT w.id, round(w.fx + coalesce(rp.fx, 0) + coalesce(sp.fx, 0), 3) AS fx, round(w.fy + coalesce(rp.fy, 0) + coalesce(sp.fy, 0), 3) AS fy FROM w LEFT JOIN rp ON rp.id = w.id LEFT JOIN sp ON sp.id = w.id", "edges",
)
def layout_planar_forces(spark, d):
    nodes, edges = _laid_out(spark, d)
    return rounded(layout.planar_forces(nodes, edges, layout.Configuration()), 3)


@query("SELECT round((lon - s / 2 + 180) / 360 * 268435456, 2) AS x, round(s / 360 * 268435456, 2) AS width FROM (SELECT CASE WHEN p <= q THEN (lo + hi) / 2 WHEN (le + he) / 2 > 180 THEN (le + he) / 2 - 360 ELSE (le + he) / 2 END AS lon, least(p, q) AS s FROM (SELECT min(longitude) AS lo, max(longitude) AS hi, max(longitude) - min(longitude) AS p, min(e) AS le, max(e) AS he, max(e) - min(e) AS q FROM (SELECT *, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS e FROM points)))", "points")
def mercator_rect(spark, d):
    return rounded(spatial.mercator_rect(spatial.region(domain.points(spark, d))).select("x", "width"), 2)


@query("SELECT a.name AS a, b.name AS b, c.name AS c, CASE WHEN abs(x) < 1e-10 THEN 'collinear' WHEN x > 0 THEN 'clockwise' ELSE 'counterclockwise' END AS turn FROM nation_points a JOIN nation_points b ON a.name < b.name JOIN nation_points c ON b.name < c.name, LATERAL (SELECT (b.latitude - a.latitude) * (c.longitude - b.longitude) - (b.longitude - a.longitude) * (c.latitude - b.latitude) AS x)", "nation_points")
def orientation_of_triples(spark, d):
    p = domain.nation_points(spark, d)
    a, b, c = (p.select(F.col("name").alias(n), F.col("longitude").alias(f"x{n}"), F.col("latitude").alias(f"y{n}")) for n in "abc")
    three = a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c"))
    return three.select("a", "b", "c", spatial.orientation(*[F.col(f"{x}{n}") for n in "abc" for x in "xy"]).alias("turn"))


@query(f"WITH {LONG} SELECT i, 'Key' AS label, max(value) FILTER (j = 1) AS jan, max(value) FILTER (j = 12) AS dec FROM m WHERE j IN (1, 12) GROUP BY i")
def matrix_as_table(spark, d):
    m = _long(spark, d).where("j in (1, 12)").withColumn("j", F.when(F.col("j") == 1, 0).otherwise(1))
    out = tables.from_matrix(m, ["jan", "dec"])
    return out.df.select("i", F.lit("Key").alias("label"), "jan", "dec")


@query("SELECT c_custkey AS i, j::INTEGER AS j, CASE j WHEN 0 THEN c_acctbal ELSE coalesce(c_nationkey, 0)::DOUBLE END AS value FROM customer, range(0, 2) r(j)")
def table_as_matrix(spark, d):
    return matrices.as_matrix(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query("SELECT count(c_acctbal) AS n FROM customer WHERE c_acctbal IS NOT NULL")
def numeric_column(spark, d):
    return tables.RoleFrame(table(spark, d, "customer")).column("c_acctbal").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'number' AS kind, value AS number, event_type AS category FROM events")
def plot_values(spark, d):
    t = tables.RoleFrame(table(spark, d, "events"))
    return t.df.select("event_id", t.plot_value("value").alias("v"), t.plot_value("event_type").alias("c")).select("event_id", "v.kind", "v.number", "c.category")


@query("SELECT ts AS x, value AS y, event_type AS series, true AS grouped FROM events WHERE isfinite(value)")
def time_series_rows(spark, d):
    return tables.time_series_rows(tables.RoleFrame(table(spark, d, "events"), {"x": "ts", "y": "value", "series": "event_type"}))


@query("SELECT 0.0::DOUBLE AS low, round(max(c_acctbal) * 1.1, 6) AS high FROM customer")
def number_line_domain(spark, d):
    return rounded(tables.number_line_domain(tables.RoleFrame(table(spark, d, "customer"), {"y": "c_acctbal"})))


@query("SELECT c_custkey::VARCHAR AS c_custkey, printf('%.3f', c_acctbal) AS c_acctbal FROM customer")
def formatted_grid(spark, d):
    return tables.formatted(table(spark, d, "customer").select("c_custkey", "c_acctbal"))


@query()
def glm_permutation_null(spark, d):
    """Null of the model mean square of price on quantity over all parts' retail prices and sizes."""
    p = table(spark, d, "part").select(F.col("p_size").cast("double"), "p_retailprice").toArrow()
    return resampling.glm_permutations(spark, p.column(0).to_numpy()[:, None], p.column(1).to_numpy(), 99, 7)[1]


@query(f"WITH {MATERIALISED}, {relabel('3', PERMUTATIONS)} SELECT iter, round(va / (va + vw), 6) AS value FROM v", "g_snp", "labels_of")
def amova_permutation_test(spark, d):
    return rounded(distance.genetic_permutations(domain.snp(spark, d), domain.labels(spark, d), PERMUTATIONS, 3))


@query()
def component_sds(spark, d):
    sds = matrices.component_sds(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame(list(enumerate(sds)), "component int, sd double")


@query()
def dominant_eigenvector(spark, d):
    e = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("j", "value"), F.col("vec_id").alias("i"))
    g = matrices.multiply(matrices.transpose(e.select("i", "j", F.col("value").cast("double").alias("value"))), e.select("i", "j", F.col("value").cast("double").alias("value")))
    v = matrices.dominant_eigenvector(g, 1e-6)
    return spark.createDataFrame(list(enumerate(v or [])), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("value", T.DoubleType())]))


@query("SELECT k::INTEGER AS k, round(exp(lgamma(5) - lgamma(k + 1) - lgamma(5 - k) + lgamma(37) - lgamma(8 - k) - lgamma(30 + k) - lgamma(41) + lgamma(8) + lgamma(34)), 9) AS p FROM range(0, 5) r(k)")
def hypergeometric_pmf(spark, d):
    return spark.createDataFrame([(k, round(statistics.hypergeometric(40, 4, 7, k), 9)) for k in range(5)], "k int, p double")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pink' WHEN 'O' THEN 'blue' ELSE 'primary' END AS colour FROM orders")
def lineage_colours(spark, d):
    code = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", text.lineage_colour(code).alias("colour"))
