import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import distance, frequencies, outcrossing, parentage, resampling, simulation
from popspark.plans import domain

G = "ind int, locus int, a1 int, a2 int"


def panel(spark, rows):
    return spark.createDataFrame(rows, G)


def test_frequencies_and_degenerate_diversity(spark):
    g = panel(spark, [(0, 0, 1, 2), (1, 0, 1, 1), (2, 0, 2, 0), (3, 0, 0, 0), (0, 1, 0, 0)])
    d = {r.locus: r for r in frequencies.diversity(g).collect()}
    assert (d[0].N, d[0].A) == (5, 2) and math.isclose(d[0].Ho, 1 / 3) and math.isclose(d[0].He, 1 - (9 + 4) / 25)
    assert (d[1].N, d[1].A, d[1].Ae, d[1].He) == (0, 0, 0, 1) and math.isnan(d[1].Ho)
    assert math.isclose(sum(r.p for r in frequencies.frequencies(g).collect()), 1)
    taken = frequencies.allele_counts(g.withColumn("w", F.lit(1)).unionByName(g.where("ind = 0").withColumn("w", F.lit(-1))), weight=F.col("w"))
    assert sorted(tuple(r) for r in taken.collect()) == [(0, 1, 2), (0, 2, 1)]


def test_genotype_predicates(spark):
    r = spark.range(1).select(frequencies.heterozygous_labels(F.lit("A"), F.lit("")).alias("hap"), frequencies.heterozygous(F.lit(1), F.lit(0)).alias("col"), frequencies.ploidy(F.lit(1), F.lit(0)).alias("p"), frequencies.label(F.lit("A"), F.lit("B")).alias("l"), frequencies.dosage(F.lit(3)).alias("d"), frequencies.dosage(F.lit(0)).alias("none")).first()
    assert (r.hap, r["col"], r.p, r.l, r.d, r.none) == (True, False, 1, "A:B", 2, None)


def test_codebook_encode_decode(spark):
    cells = spark.createDataFrame([(0, 0, "B", "A"), (1, 0, "A", "C"), (2, 0, "", "")], "ind int, locus int, left string, right string")
    book = frequencies.codebook(cells, "locus", "ind", "left", "right")
    assert {r.label: r.allele_index for r in book.collect()} == {"B": 1, "A": 2, "C": 3}
    g = frequencies.encode(cells, book, "locus", "ind", "left", "right")
    assert sorted((r.ind, r.a1, r.a2) for r in g.collect()) == [(0, 1, 2), (1, 2, 3), (2, 0, 0)]
    assert sorted((r.ind, r.left, r.right) for r in frequencies.decode(g, book).collect()) == [(0, "B", "A"), (1, "A", "C"), (2, "", "")]
    freqs = frequencies.frequencies(g)
    assert "0.2500" in frequencies.markdown_rows(freqs).first().row and frequencies.html_rows(freqs).first().row.startswith("<tr><td>")


def naive(rows, strategy):
    """Distances from the definition."""
    cells, loci = {(i, l): (a, b) for i, l, a, b in rows}, sorted({l for _, l, _, _ in rows})
    inds, alleles = sorted({i for i, *_ in rows}), {l: sorted({x for (i, m), p in cells.items() if m == l for x in p if x}) for l in loci}
    freq = {}
    for l in loci:
        seen = [x for (i, m), p in cells.items() if m == l for x in p if x]
        freq[l] = {a: seen.count(a) / len(seen) for a in alleles[l]}

    def vec(i, l):
        p = cells[i, l]
        if 0 in p:
            return [2 * freq[l][a] for a in alleles[l]] if strategy == "impute" else None
        return [p.count(a) for a in alleles[l]]

    out = {}
    for i, j in itertools.combinations(inds, 2):
        ds = [0.5 * sum((x - y) ** 2 for x, y in zip(vec(i, l), vec(j, l))) for l in loci if vec(i, l) is not None and vec(j, l) is not None]
        out[i, j] = sum(ds) if strategy == "impute" else 0.0 if not ds else sum(ds) / len(ds) * (len(loci) if strategy == "rescaleToTotalLoci" else 1)
    return out


@pytest.mark.parametrize("strategy", distance.STRATEGIES)
def test_distances_match_definition(spark, strategy, monkeypatch):
    monkeypatch.setattr(distance.genotype_bits, "BLOCK", 5)
    rng = random.Random(7)
    rows = [(i, l, *((0, 0) if rng.random() < 0.15 else (rng.randint(1, 4), 0) if rng.random() < 0.1 else (rng.randint(1, 4), rng.randint(1, 4)))) for i in range(17) for l in range(6)] + [(99, l, 0, 0) for l in range(6)]
    got = {(r.i, r.j): r.d2 for r in distance.genetic_distance(panel(spark, rows), strategy).collect()}
    want = naive(rows, strategy)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_distance_goldens(spark):
    g = panel(spark, [(0, 0, 1, 1), (1, 0, 1, 2), (2, 0, 2, 2), (3, 0, 0, 0)])
    assert {(r.i, r.j): r.d2 for r in distance.locus_distances(g).collect()} == {(0, 1): 1, (1, 2): 1, (0, 2): 4}
    three = panel(spark, [(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 1), (1, 0, 1, 2), (1, 1, 1, 2), (1, 2, 1, 2), (2, 0, 1, 2), (2, 1, 0, 0), (2, 2, 1, 2)])
    assert {(r.i, r.j): r.d2 for r in distance.genetic_distance(three).collect()}[0, 2] == 3
    with pytest.raises(ValueError):
        distance.genetic_distance(g, "other")


PAIRS = [(0, 1, 2.0), (2, 3, 2.0), (0, 2, 8.0), (0, 3, 8.0), (1, 2, 8.0), (1, 3, 8.0)]


def test_amova_golden(spark):
    d = spark.createDataFrame(PAIRS, "i int, j int, d2 double")
    s = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "ind int, stratum string")
    r = distance.decompose(d, s).first()
    assert (r.ss_total, r.ss_within, r.ss_among, r.var_among, r.var_within, r.phi) == (9, 2, 7, 3, 1, 0.75)
    assert [x.phi for x in distance.pairwise_phi(d, s).collect()] == [0.75]
    lone = distance.decompose(d, s.withColumn("stratum", F.lit("x"))).first()
    assert (lone.phi, lone.var_among) == (0, 0) and distance.pairwise_phi(d, s.withColumn("stratum", F.lit("x"))).count() == 0


def test_phi_forms_agree(spark):
    rng = np.random.default_rng(2)
    pts, groups = rng.normal(size=(12, 3)), [f"p{i % 3}" for i in range(12)]
    pairs = [(i, j, float(((pts[i] - pts[j]) ** 2).sum())) for i in range(12) for j in range(i + 1, 12)]
    d = spark.createDataFrame(pairs, "i int, j int, d2 double")
    s = spark.createDataFrame(list(enumerate(groups)), "ind int, stratum string")
    dense = np.zeros((12, 12))
    for i, j, v in pairs:
        dense[i, j] = dense[j, i] = v
    phi = distance.decompose(d, s).first().phi
    assert math.isclose(phi, distance.phi_of(dense, np.array(groups)))
    for r in distance.pairwise_phi(d, s).collect():
        two = s.where(F.col("stratum").isin(r.GroupA, r.GroupB))
        inside = d.join(two.select(F.col("ind").alias("i")), "i", "left_semi").join(two.select(F.col("ind").alias("j")), "j", "left_semi")
        assert math.isclose(r.phi, distance.decompose(inside, two).first().phi, abs_tol=1e-12)
    null = distance.permuted_phi(d, resampling.relabelled(s, "ind", "stratum", 3, "seed")).collect()
    assert len({r.iter for r in null}) == 3
    observed, values = distance.permutation_test(d, s, 40, 5)
    again = distance.permutation_test(d, s, 40, 5)[1]
    assert math.isclose(observed, phi) and values.orderBy("iter").collect() == again.orderBy("iter").collect()
    steps = distance.permutation_progress(d, s, 40, 15, 5).orderBy("done").collect()
    assert [r.done for r in steps] == [15, 30, 40] and math.isclose(steps[-1].p_value, resampling.p_value(values, observed).first().p_value)


def test_resampling(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "value double")
    assert resampling.p_value(v, 3.0).first().p_value == 3 / 5 and resampling.p_value(v, 3.0, direction="less").first().p_value == 4 / 5
    assert resampling.p_value(v, 3.0, direction="two-sided").first().p_value == 1 and math.isnan(resampling.p_value(v.limit(0), 1.0).first().p_value)
    assert resampling.p_value_of(np.array([1, 2, 3, 4]), 3) == 3 / 5
    running = resampling.running_p_value(v.withColumn("iter", F.col("value").cast("int")), 3.0).orderBy("iter").collect()
    assert [r.p_value for r in running] == [1 / 2, 1 / 3, 2 / 4, 3 / 5]
    pop = spark.range(50).select(F.col("id").alias("u"))
    sub = resampling.subsamples(pop, "u", 5, 3, "s")
    assert sub.groupBy("iter").count().collect() and all(r["count"] == 5 for r in sub.groupBy("iter").count().collect())
    assert sub.distinct().count() == 15 and sorted(map(tuple, sub.collect())) == sorted(map(tuple, resampling.subsamples(pop.repartition(7), "u", 5, 3, "s").collect()))
    labels = resampling.relabelled(pop.withColumn("g", F.col("u") % 3), "u", "g", 2, "s")
    assert all(r["count"] == n for r, n in zip(labels.groupBy("iter", "g").count().orderBy("iter", "g").collect(), [17, 17, 16] * 2))
    x = np.arange(20.0)
    observed, null = resampling.glm_permutations(spark, x[:, None], 3 * x + 1, 60, 1)
    assert resampling.p_value(null, observed).first().p_value <= 2 / 61
    assert resampling.subsample_test(spark, x, 5, lambda s: float(s.mean()), 7, 3).count() == 7


def test_rarefaction_guards(spark):
    g = panel(spark, [(i, 0, 1 + i % 3, 1 + i % 2) for i in range(40)])
    assert resampling.rarefaction(g, "A", 9) is None and resampling.rarefaction(g, "Ho", 40) is None and resampling.rarefaction(g, "Undefined", 20) is None and resampling.rarefaction(g, "A", 10, 1) is None
    assert resampling.rarefaction(g, "Fis", 20) is None and resampling.allelic_rarefaction(g, "A", 41).count() == 0
    assert all(1 <= r.value <= 3 for r in resampling.rarefaction(g, "A", 10, 5).collect())
    assert all(0 <= r.value <= 1 for m in ("Ho", "He") for r in resampling.rarefaction(g, m, 10, 5).collect())


def test_paternal_gamete(spark):
    cases = {((1, 2), (1, 1)): ("resolved", 2), ((1, 2), (1, 2)): ("ambiguous", 1), ((1, 1), (1, 2)): ("resolved", 1), ((3, 4), (1, 2)): ("impossible", 0), ((0, 1), (1, 1)): ("missing", 0), ((1, 2), (0, 0)): ("missing", 0), ((2, 3), (1, 3)): ("resolved", 2)}
    for (o, m), want in cases.items():
        r = spark.range(1).select(parentage.paternal_gamete(*map(F.lit, (*o, *m))).alias("g")).first().g
        assert (r.status, r.p1) == want, (o, m)


def test_correlated_paternity_single_father(spark):
    fam = spark.createDataFrame([(f, 100 + f) for f in range(4)] + [(9, None)], "family int, mother int")
    kids = spark.createDataFrame([(f, f * 10 + k, k) for f in range(4) for k in range(4)] + [(9, 90, 0), (9, 91, 1)], "family int, offspring int, place int")
    rows = [(100 + f, 0, 9, 9) for f in range(4)] + [(f * 10 + k, 0, 9, f + 1) for f in range(4) for k in range(4)] + [(90, 0, 1, 2), (91, 0, 1, 2)]
    p = parentage.gametes(panel(spark, rows), fam, kids, False)
    r = parentage.correlated_paternity(p).first()
    assert (r.rp, r.pairs, r.donors) == (1, 24, 1)
    assert parentage.correlated_paternity(p.limit(0)).first().pairs == 0 and math.isnan(parentage.correlated_paternity(p.limit(0)).first().rp)
    assert parentage.correlated_paternity(p, "family").count() == 4
    tall = parentage.pollen_tallies(parentage.gametes(panel(spark, rows), fam, kids)).first()
    assert (tall.resolved, tall.missing) == (16, 2)
    assert parentage.mothers(fam).count() == 4 and parentage.offspring_of(kids, fam).count() == 18


def table_selfing(o, m, null):
    """Mendel by listing: visible outcomes of the mother's gamete pairs."""
    seen = []
    for a in m:
        for b in m:
            pair = sorted((a, b))
            if null and pair[1] == 0:
                continue
            seen.append(tuple((pair[1], pair[1]) if null and pair[0] == 0 else pair))
    return seen.count(tuple(sorted(o))) / len(seen) if seen else 0.0


def test_outcrossing_probabilities(spark):
    freqs = [0.2, 0.3, 0.5]
    rows = [(o1, o2, m1, m2, n) for o1 in range(1, 3) for o2 in range(1, 3) for m1 in range(3) for m2 in range(3) for n in (False, True)]
    df = spark.createDataFrame(rows, "o1 int, o2 int, m1 int, m2 int, n boolean").withColumn("f", F.array(*map(F.lit, freqs)))
    args = [F.col(c) for c in ("o1", "o2", "m1", "m2")]
    for r in df.withColumn("s", outcrossing.selfing(*args, F.col("n"))).withColumn("o", outcrossing.outcrossing(*args, F.col("f"), F.col("n"))).collect():
        o, m = (r.o1, r.o2), (r.m1, r.m2)
        assert math.isclose(r.s, table_selfing(o, m, r.n), abs_tol=1e-12), r
        kids, mother = np.array([o]), np.array(m)
        assert math.isclose(r.s, outcrossing.selfing_array(kids, mother, r.n)[0], abs_tol=1e-12) and math.isclose(r.o, outcrossing.outcrossing_array(kids, mother, np.array(freqs), r.n)[0], abs_tol=1e-12)
    golden = lambda o, m: outcrossing.outcrossing_array(np.array([o]), np.array(m), np.array(freqs), True)[0]
    assert math.isclose(golden((2, 2), (0, 2)), 0.6625) and math.isclose(golden((1, 1), (0, 2)), 0.1875) and math.isclose(golden((1, 1), (1, 2)), 0.25)


def test_likelihood_is_a_mixture_of_products(spark):
    rows = [(0, 0, l, 1, 1, 1, 1, [0.0, 0.5, 0.5], False) for l in range(2)]
    df = spark.createDataFrame(rows, "family int, offspring int, locus int, o1 int, o2 int, m1 int, m2 int, freqs array<double>, null boolean")
    assert math.isclose(math.exp(outcrossing.progeny_log_likelihood(df, 0.5).first().loglik), 0.625)
    skew = df.withColumn("freqs", F.array(F.lit(0.0), F.sqrt(F.lit(0.28)), F.lit(0.0)))
    assert math.isclose(math.exp(outcrossing.progeny_log_likelihood(skew, 0.5).first().loglik), 0.64)
    none = outcrossing.progeny_log_likelihood(df.withColumn("o1", F.lit(2)).withColumn("o2", F.lit(2)).withColumn("m2", F.lit(1)).withColumn("freqs", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))), 0.5).first()
    assert none.loglik == -math.inf
    mother = outcrossing.mother_log_likelihood(df.select("family", "locus", "m1", "m2", "freqs", F.lit(0).alias("history")))
    assert math.isclose(mother.first().loglik, 2 * math.log(0.25))
    whole = outcrossing.family_log_likelihood(mother, outcrossing.progeny_log_likelihood(df, 0.5))
    assert math.isclose(outcrossing.population_log_likelihood(whole).first().loglik, 2 * math.log(0.25) + math.log(0.625))


def families(spark, t, n=12, kids=10, loci=4, seed=3):
    rng = random.Random(seed)
    rows, fam, off = [], [], []
    for f in range(n):
        mother = 100_000 + f
        hers = [(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(loci)]
        rows += [(mother, l, *p) for l, p in enumerate(hers)]
        fam.append((f, mother))
        for k in range(kids):
            ind = f * 100 + k
            off.append((f, ind, k))
            out = rng.random() < t
            rows += [(ind, l, rng.choice(hers[l]), rng.randint(1, 4) if out else rng.choice(hers[l])) for l in range(loci)]
    return spark.createDataFrame(fam, "family int, mother int"), spark.createDataFrame(off, "family int, offspring int, place int"), panel(spark, rows)


@pytest.mark.parametrize("t", [0.1, 0.9])
def test_chain_recovers_the_rate(spark, t):
    fam, kids, g = families(spark, t)
    p = outcrossing.Parameters(steps=700, burn_in=200, thinning=10, seed=4)
    samples = outcrossing.run_chains(g, fam, kids, p)
    samples = spark.createDataFrame(samples.collect(), samples.schema)
    mean = outcrossing.posterior_mean_t(samples).first().mean_t
    assert samples.count() == 50 and (mean < 0.35 if t < 0.5 else mean > 0.65)
    ci = outcrossing.credible_interval(samples).first()
    assert ci.low <= mean <= ci.high and outcrossing.credible_interval(samples, 1.0).first().high <= 1
    assert math.isclose(sum(r.share for r in outcrossing.posterior_histories(samples).collect()), 1)
    assert 0 <= outcrossing.posterior_mean_f(samples).first().mean_f <= 1 and "outcrossing rate" in outcrossing.summary(samples)


def test_chain_is_reproducible_and_by_locus(spark):
    fam, kids, g = families(spark, 0.5, n=3, kids=4, loci=2)
    fam = fam.withColumn("mother", F.when(F.col("family") > 0, F.col("mother")))
    p = outcrossing.Parameters(steps=30, burn_in=10, thinning=5, seed=4)
    run = lambda: sorted(map(str, outcrossing.run_chains(g, fam, kids, p, null_loci=(0,), by_locus=True).collect()))
    assert run() == run() and len(run()) == 8


def test_simulation(spark):
    r = spark.range(1).select(simulation.mate(F.lit("B"), F.lit("C"), F.lit("A"), F.lit("D"), F.lit(0.1), F.lit(0.1)).alias("m")).first().m
    assert (r.left, r.right, r.left_lineage, r.right_lineage) == ("A", "B", 1, -1)
    freqs = spark.createDataFrame([("L", "a", 0.25), ("L", "b", 0.75)], "locus string, allele string, p double")
    pop = simulation.make_population(freqs, "P", 400, "s")
    b = pop.select(F.explode(F.array("left", "right")).alias("x")).where("x = 'b'").count()
    assert pop.count() == 400 and 0.65 < b / 800 < 0.85 and pop.where("ind = 'P-001'").count() == 1
    kids = simulation.random_mate(pop, pop.select("ind"), 30, "m")
    assert kids.count() == 30 and kids.where("left > right").count() == 0
    assert simulation.random_mate(pop, pop.select("ind").limit(0), 5, "m").count() == 0
    code = lambda *a: tuple(spark.range(1).select(simulation.set_lineage(*map(F.lit, a)).alias("l")).first().l or ())
    assert code("A", "B", "A", "B") == (2, 2) and code("A", "A", "A", "A") == (-1, 1) and code("A", "C", "A", "B") == (-1, 1) and code("C", "A", "A", "B") == (1, -1) and code("C", "D", "A", "B") == (3, 3) and code("A", "", "A", "B") == ()


def test_migration_clamp(spark):
    people = spark.createDataFrame([(i, "A") for i in range(3)], "ind int, population string")
    out = simulation.apply_migration(people, [("A", "A", 0.0), ("A", "B", 0.5), ("A", "C", 0.5)], "s")
    n = {r.population: r["count"] for r in out.groupBy("population").count().collect()}
    assert n == {"B": 2, "C": 1}
    with pytest.raises(ValueError):
        simulation.apply_migration(people, [("A", "B", 0.5)], "s")


def test_heterozygosity_on_tables(spark, sf):
    g = domain.msat(spark, sf)
    total = frequencies.allele_counts(g).agg(F.sum("n")).first()[0]
    assert total == g.select(F.sum((F.col("a1") != 0).cast("int") + (F.col("a2") != 0).cast("int"))).first()[0]
