import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import graphs, layout, matrices, statistics


def test_regression_goldens(spark):
    df = spark.createDataFrame(list(zip(map(float, range(1, 6)), (2.0, 4.0, 5.0, 4.0, 5.0))), "x double, y double")
    r = statistics.simple_regression(df, "y", "x").first()
    fit = statistics.linear_model(df, "y", ["x"])
    for got in ((r.intercept, r.slope, r.r2, r.f), (*fit.coefficients, fit.r2, fit.f_statistic)):
        assert np.allclose(got, (2.2, 0.6, 0.6, 4.5))
    assert {x.term for x in statistics.summary_table(statistics.simple_regression(df, "y", "x")).collect()} == {"slope", "intercept", "rSquared"}
    assert statistics.fitted(df, fit, "y", ["x"]).agg(F.sum("residual")).first()[0] < 1e-9
    assert statistics.linear_model(df.limit(1), "y", ["x"]) is None and statistics.linear_model(df.withColumn("z", F.col("x") * 2), "y", ["x", "z"]) is None
    assert [x[0] for x in statistics.anova_of_fit(fit)] == ["Model", "Residual", "Total"] and statistics.anova_of_fit(None) == []
    two = statistics.linear_model(df.limit(2), "y", ["x"])
    assert two.df_residual == 0 and not math.isfinite(two.f_statistic)


def test_anova_golden(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 12.0), ("b", math.nan), (None, 1.0)], "g string, y double")
    t = {r.source: r for r in statistics.anova_one_way(df, "g", "y").collect()}
    assert math.isclose(t["Residual"].ss, 4) and math.isclose(t["Total"].ss, 101.2) and math.isclose(t["Model"].f, 72.9) and math.isnan(t["Total"].ms)


def test_hypergeometric(spark):
    assert abs(statistics.hypergeometric(40, 4, 7, 1) - 0.41790) < 1e-4 and statistics.hypergeometric(40, 4, 7, 5) == 0 and math.isnan(statistics.hypergeometric(3, 4, 1, 1))
    cases = spark.createDataFrame([(40, 4, 7, 1), (40, 4, 7, 0), (40, 4, 7, 9), (3, 4, 1, 1)], "population long, successes long, draws long, k long")
    r = {x.k if x.population == 40 else "bad": x for x in statistics.hypergeometric_scenarios(cases).collect()}
    assert abs(r[1].exact - 0.41790) < 1e-4 and math.isclose(r[0].at_least, 1) and r[9].at_least == 0 and r[9].less_than == 1 and math.isnan(r["bad"].exact)


def test_log_factorial(spark):
    ns = spark.createDataFrame([(n,) for n in [-1, *range(40), 10**6, 10**12]], "n long")
    for r in ns.select("n", statistics.log_factorial(F.col("n")).alias("lf")).collect():
        assert r.lf is None if r.n < 0 else math.isclose(r.lf, math.lgamma(r.n + 1), rel_tol=1e-13, abs_tol=1e-13)


def test_medoid_clusters(spark):
    rows = [(i, float(i % 3 * 100 + i // 3), 0.0, 0.0) for i in range(12)] + [(12, 3.5, 0.0, 0.0)]
    out = statistics.medoid_clusters(spark.createDataFrame(rows, "id int, x double, y double, z double"), 3).collect()
    assert len(out) == 13 and sorted({(r.cluster, r["size"]) for r in out})[0] == (0, 5)
    assert statistics.medoid_clusters(spark.createDataFrame(rows[:2], "id int, x double, y double, z double"), 5).count() == 2


def test_tsne_affinities(spark):
    pts = spark.createDataFrame([(i, [float(i), float(i * i % 5)]) for i in range(5)], "k int, v array<double>")
    p = statistics.tsne_affinities(pts, "k", "v", 3.0).collect()
    cell = {(r.i, r.j): r.p for r in p}
    assert math.isclose(sum(cell.values()), 1) and all(math.isclose(cell[a, b], cell[b, a]) for a, b in cell) and not any(a == b for a, b in cell)
    beta, probs, reached, used = statistics.search_beta(np.array([1.0, 4.0, 9.0, 16.0]), 3.0)
    assert math.isclose(reached, 3, rel_tol=1e-3) and math.isclose(probs.sum(), 1) and used <= 50


A = [[1.0, 2.0], [3.0, 4.0]]


def cells(m):
    return {(r.i, r.j): r.value for r in m.collect()}


def test_matrix_algebra(spark):
    a, n = matrices.from_nested(spark, A), np.array(A)
    as_dict = lambda x: {(i, j): v for (i, j), v in np.ndenumerate(x)}
    assert cells(matrices.multiply(a, matrices.transpose(a))) == as_dict(n @ n.T)
    for op, want in (("+", n + n.T), ("-", n - n.T), ("*", n * n.T), ("/", n / n.T)):
        assert cells(matrices.elementwise(a, op, matrices.transpose(a))) == as_dict(want)
    assert cells(matrices.scalar(a, "/", 0))[0, 0] == math.inf and matrices.elementwise(a, "+", a.where("i = 0")).count() == 0
    assert matrices.trace(a).first().trace == 5 and matrices.total(a).first().total == 10
    assert {r.i: r.value for r in matrices.multiply_vector(a, matrices.diagonal(a)).collect()} == {0: 9, 1: 19}
    assert matrices.equal(a, a).first().equal and not matrices.equal(a, matrices.transpose(a)).first().equal
    assert cells(matrices.row_matrix(a)) == as_dict(n.sum(1)[:, None] * np.ones((1, 2)))
    assert cells(matrices.diagonal_matrix(matrices.diagonal(a))) == as_dict(np.diag([1.0, 4.0])) and cells(matrices.set_diagonal(a, matrices.diagonal(matrices.scalar(a, "*", 2))))[1, 1] == 8
    assert cells(matrices.linspace(spark, 0, 1, 2, 2))[1, 1] == 1 and matrices.filled(spark, 2, 3, 7).count() == 6
    got = cells(matrices.gather(a, spark.createDataFrame([(0, 1), (1, 9)], "at int, i int"), spark.createDataFrame([(0, 0), (1, 0)], "at int, j int")))
    assert got[0, 0] == got[0, 1] == 3 and math.isnan(got[1, 0])
    assert cells(matrices.from_json(matrices.to_json(a))) == cells(a) and sorted(r["row"] for r in matrices.to_arrays(a).collect()) == A
    assert matrices.row(a, 1).count() == 2 and matrices.col(a, 1).count() == 2 and cells(matrices.from_arrays(matrices.to_arrays(a), "i", "row")) == cells(a)
    wide = spark.createDataFrame([(0, 1.0, None)], "k int, p double, q double")
    assert cells(matrices.as_matrix(wide, "k", ["p", "q"])) == {(0, 0): 1, (0, 1): 0}


def test_triangles_and_covariance(spark):
    t = spark.createDataFrame([(0, 1, 1.0), (0, 2, 4.0), (1, 2, 9.0)], "i int, j int, value double")
    d = matrices.dense(t)
    back = cells(matrices.distance_from_covariance(matrices.gower_centered(d)))
    assert all(math.isclose(v, back[k], abs_tol=1e-9) for k, v in cells(d).items())
    assert cells(matrices.add_triangles(t, t, -1)) == {(0, 1): 0, (0, 2): 0, (1, 2): 0}
    assert cells(matrices.triangle_gather(t, spark.createDataFrame([(0, 2), (1, 0)], "at int, i int"))) == {(0, 1): 4}
    s = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "r int, g string")
    assert cells(matrices.design_matrix(s, "r", "g"))[1, 0] == 1 and cells(matrices.hat_matrix(s, "r", "g")) == {(0, 0): 0.5, (0, 2): 0.5, (2, 0): 0.5, (2, 2): 0.5, (1, 1): 1}


def test_factorisations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4)) @ np.diag([5, 3, 2, 1]) + 10
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>").repartition(3)
    d, v, _, _ = matrices.singular_values(df, "v")
    assert np.allclose(d, np.linalg.svd(x, compute_uv=False)) and np.allclose(v.T @ v, np.eye(4))
    c = x - x.mean(0)
    assert np.allclose(matrices.component_sds(df, "v"), np.linalg.svd(c, compute_uv=False) / math.sqrt(39))
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    got = np.array([[r.pc1, r.pc2] for r in matrices.principal_components(df, "k", "v").orderBy("k").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    raw = np.array([[r.pc1] for r in matrices.principal_components(df, "k", "v", 1, center=False).orderBy("k").collect()])
    assert np.allclose(np.abs(raw[:, 0]), np.abs(x @ np.linalg.svd(c)[2][0]))
    assert np.allclose(matrices.generalized_inverse(np.array(A)) @ A, np.eye(2)) and matrices.generalized_inverse(np.ones((2, 2))).size == 0 and matrices.generalized_inverse(np.ones((2, 3))).size == 0
    e = matrices.dominant_eigenvector(matrices.from_nested(spark, [[2.0, 1.0], [1.0, 2.0]]))
    assert np.allclose(np.abs(e), [2**-0.5] * 2) and matrices.dominant_eigenvector(matrices.from_nested(spark, [[0.0, 1.0], [1.0, 0.0]])) is None
    assert matrices.r_matrix(A) == "matrix( c(1.0, 2.0, 3.0, 4.0), ncol=2, nrow=2, byrow=TRUE)" and matrices.r_matrix(A, ["a", "b"], ["x", "y"]).startswith('tibble(Key = c("a", "b"), x = c(1.0, 3.0)')


def test_small_graph_goldens(spark):
    nodes, edges = graphs.small_graph(spark)
    deg = {r.id: (r.out_degree, r.in_degree) for r in graphs.degrees(nodes, edges).collect()}
    assert deg == {"A": (2, 2), "B": (2, 2), "C": (3, 2), "D": (0, 1)}
    paths = graphs.shortest_paths(nodes, edges)
    by = {(r.src, r.dst): r for r in paths.collect()}
    assert by["A", "C"].path == ["A", "C"] and by["A", "D"].distance == 7 and ("D", "A") not in by and by["A", "A"].path == ["A"]
    close = {r.id: r.closeness for r in graphs.closeness(nodes, paths).collect()}
    assert np.allclose([close[k] for k in "ABCD"], [3 / 11, 1 / 3, 1 / 3, 0])
    between = {r.id: r.betweenness for r in graphs.betweenness(nodes, graphs.path_forest(nodes, edges)).collect()}
    assert np.allclose([between[k] for k in "ABCD"], [0, 0, 1 / 3, 0])
    assert {(r.i, r.j): r.value for r in graphs.adjacency(edges.unionByName(spark.createDataFrame([(9, "A", "B", 5.0)], edges.schema))).collect()}["A", "B"] == 5
    assert graphs.cardinality(nodes).first().nodes == 4 and graphs.ends(edges, nodes).count() == 7


def test_eigenvector_both_ways(spark):
    nodes, edges = graphs.small_graph(spark)
    small = {r.id: r.value for r in graphs.eigenvector(nodes, edges).collect()}
    far = {r.id: r.value for r in graphs.eigenvector(nodes, edges, small=1).collect()}
    assert all(math.isclose(small[k], far[k], abs_tol=1e-4) for k in small) and graphs.eigenvector(nodes.limit(0), edges.limit(0)).count() == 0


def test_graph_editing(spark):
    nodes, edges = graphs.small_graph(spark)
    more = spark.createDataFrame([("A", "D", 1.0), ("A", "Z", 1.0)], "a string, b string, weight double")
    assert graphs.add_edges(edges, nodes, more).count() == 9 and graphs.add_edges(edges, nodes, more, False).count() == 8
    assert graphs.add_nodes(nodes, spark.createDataFrame([("E",)], "id string")).count() == 5
    placed = graphs.random_layout(nodes, 1).collect()
    assert all(abs(r.x) <= 500 and r.z == 0 for r in placed) and placed == graphs.random_layout(nodes, 1).collect()


def laid_out(spark, rows):
    schema = "id string, ordinal int, x double, y double, z double, vx double, vy double, vz double, radius double, pinned boolean, px double, py double, pz double"
    return spark.createDataFrame([(n, i, x, y, 0.0, 0.0, 0.0, 0.0, r, False, 0.0, 0.0, 0.0) for i, (n, x, y, r) in enumerate(rows)], schema)


def test_layout(spark):
    nodes = laid_out(spark, [("a", 0.0, 0.0, 5.0), ("b", 100.0, 0.0, 5.0)])
    edges = spark.createDataFrame([(0, "a", "b", 1.0, 1.0)], "edge_ord int, src string, dst string, weight double, alpha double")
    c = layout.Configuration(gravity=0.0)
    f = {r.id: r for r in layout.forces(nodes, edges, c).collect()}
    want = -(200.0**2 / 100**2) + (100 - 200)
    assert math.isclose(f["a"].fx, want) and math.isclose(f["b"].fx, -want) and f["a"].fy == 0
    moved = {r.id: r for r in layout.integrate(layout.pin(nodes, "b", 7.0, 8.0), layout.forces(nodes, edges, c), c, c.initial_temperature).collect()}
    assert (moved["b"].x, moved["b"].y) == (7, 8) and math.isclose(moved["a"].vx, want * 0.016 * 0.9)
    end, temperature, settling = layout.run(nodes, edges, c, 2, lambda df: spark.createDataFrame(df.collect(), df.schema))
    assert math.isclose(temperature, 500 * 0.99**2) and not settling.settled and layout.kinetic_energy(end).first().energy > 0
    s = layout.Settling(0.01, 2).update(0.001).update(0.001)
    assert s.settled and s.progress == 1 and not s.update(1.0).settled
    assert layout.linear_cooling(100, 5, 10) == 50 and layout.reheated(400, c) == 500 and layout.progress(1, 4) == 0.25
    assert layout.hit(nodes, (103.0, 0.0), 1.0, (0.0, 0.0), (0.0, 0.0)).first().id == "b" and layout.hit(nodes, (50.0, 0.0), 1.0, (0.0, 0.0), (0.0, 0.0)).count() == 0
    fit = layout.fit_to_view(nodes, (1000.0, 1000.0)).first()
    assert math.isclose(fit.zoom, 4.5) and math.isclose(fit.pan_x, -225)
    view = spark.range(1).select(layout.world_to_view(F.lit(2.0), F.lit(3.0), 2.0, (1.0, 1.0), (10.0, 20.0)).alias("v")).first().v
    assert (view.x, view.y) == (10, 17)
    wall = {r.id: r for r in layout.planar_forces(laid_out(spark, [("a", 10.0, 250.0, 5.0)]), edges.limit(0), c).collect()}
    assert math.isclose(wall["a"].fx, 1000 / 100) and layout.total_energy(layout.forces(nodes, edges, c)).first().total > 0
    ramped = layout.ramp_all(edges, 0.0, 0.5).select(layout.ramp(F.col("alpha"), F.col("target"), F.col("speed"), 0.25).alias("a")).first().a
    assert ramped == 0.5 and layout.velocity_noise(nodes, 5.0, 1).where("vx = 0").count() == 0


def test_knn(spark):
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "k int, v array<double>")
    e = {(r.src, r.dst): r.weight for r in graphs.knn_edges(pts, "k", "v", 1).collect()}
    assert e[0, 1] == 1 and len(e) == 5


def test_unknown_layout_and_roles(spark):
    with pytest.raises(TypeError):
        layout.Configuration(nothing=1)
