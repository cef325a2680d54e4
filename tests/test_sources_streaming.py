import datetime
import time

import pytest
from pyspark.sql import functions as F

from popspark.operators.frequencies import decode, diversity
from popspark.sources import exporters, importers, store
from popspark.streaming import frequencies as streaming

NOW = datetime.datetime(2024, 1, 2, 3, 4, 5)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_population_table(spark, tmp_path):
    path = put(tmp_path, "p.csv", "Region,Pop,ID,Lat,Lon,L1,L2\nN,a,i1,1.5,2, A:B ,X\n\nN,,i2,,,B:B,\nS,b,i3,3,4,:,X:Y\n")
    d = importers.import_population_table(spark, path, importers.PopulationLayout(("Region", "Pop"), "ID", "Lat", "Lon"))
    assert d.individuals.count() == 3 and d.strata.where("level = 'Pop'").count() == 2 and d.individuals.where("latitude is null").count() == 1
    cells = {(r.ind, r.locus): (r.left, r.right) for r in decode(d.genotypes, d.codebooks).collect()}
    ids = sorted(r.ind for r in d.individuals.collect())
    assert cells[ids[0], 0] == ("A", "B") and cells[ids[0], 1] == ("X", "") and cells[ids[1], 1] == ("", "") and cells[ids[2], 0] == ("", "")
    assert [r.name for r in importers.import_population_table(spark, path, importers.PopulationLayout(("Pop",), loci=("L1",))).individuals.orderBy("ind").collect()][0] == "row_0"
    assert {r.locus: r.A for r in diversity(d.genotypes).collect()} == {0: 2, 1: 2}
    with pytest.raises(importers.MissingColumn):
        importers.import_population_table(spark, path, importers.PopulationLayout(("None",)))
    with pytest.raises(importers.MalformedGenotype):
        importers.import_population_table(spark, put(tmp_path, "b.csv", "Pop,L\na,1:2:3\n"), importers.PopulationLayout(("Pop",)))
    with pytest.raises(importers.EmptyInput):
        importers.import_population_table(spark, put(tmp_path, "e.csv", "Pop,L\n"), importers.PopulationLayout(("Pop",)))
    assert importers.split_csv(spark, path).orderBy(F.desc("line")).first().cells == [""]


def test_family_table(spark, tmp_path):
    path = put(tmp_path, "f.csv", "momID,OffspringID,L\n7,0,1:2\n7,1,1:3\n3,1,2:2\n7,2,2:2\n")
    d = importers.import_family_table(spark, path)
    fam = {r.family: (r.family_order, r.mother) for r in d.families.collect()}
    assert fam["7"][0] == 0 and fam["3"] == (1, None) and fam["7"][1] is not None and d.offspring.where("family = '7'").count() == 2
    with pytest.raises(importers.DuplicateMother):
        importers.import_family_table(spark, put(tmp_path, "g.csv", "momID,OffspringID,L\n7,0,1:2\n7,0,1:2\n"))
    importers.EXAMPLES["kin"] = (importers.import_family_table, path, importers.FamilyLayout())
    assert importers.load_example(spark, "kin").individuals.count() == 4


def test_dosage_triplet(spark, tmp_path):
    path = put(tmp_path, "x", "0\t0\t1\t-1\n1\t2\t0\t1\n")
    put(tmp_path, "x.indv", "i1\ni2\n")
    put(tmp_path, "x.pos", "c1\t5\nc1\t9\nc2\t1\n")
    d = importers.import_dosage_triplet(spark, path)
    assert sorted(tuple(r) for r in d.genotypes.collect()) == [(0, 0, 1, 1), (0, 1, 1, 2), (0, 2, 0, 0), (1, 0, 2, 2), (1, 1, 1, 1), (1, 2, 1, 2)]
    assert d.loci.orderBy("locus_ord").first().name == "c1:5" and d.codebooks.count() == 6
    put(tmp_path, "x.indv", "i1\n")
    with pytest.raises(importers.SideFileMismatch):
        importers.import_dosage_triplet(spark, path)
    bad = put(tmp_path, "y", "0\t7\n")
    put(tmp_path, "y.indv", "i\n")
    put(tmp_path, "y.pos", "c\t1\n")
    with pytest.raises(importers.InvalidDosageCode):
        importers.import_dosage_triplet(spark, bad)


def test_graph_files(spark, tmp_path):
    nodes, edges = importers.import_graph_text(spark, put(tmp_path, "g", "2 1\na 1.5 X\nb 2 Y\na\tb 3.25\n"))
    assert nodes.count() == 2 and sorted((r.src, r.dst, r.weight) for r in edges.collect()) == [("a", "b", 3.25), ("b", "a", 3.25)]
    for text, line in (("", None), ("2\n", 1), ("1 0\na x Y\n", 2), ("1 1\na 1 X\na b 1\n", 3), ("2 1\na 1 X\n", None)):
        with pytest.raises(importers.GraphFormatError) as e:
            importers.import_graph_text(spark, put(tmp_path, "bad", text))
        assert e.value.line == line
    geo = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"name":"a","size":3,"Region":"N","elev":7.5}},{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4]},"properties":{"name":"b"}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1.5,2.5],[3,4]]},"properties":{"weight":9}}]}'
    n, e = importers.import_geojson(spark, put(tmp_path, "g.json", geo))
    a = n.where("id = 'a'").first()
    assert (a["size"], a.categorical, a.continuous) == (3, {"Region": "N"}, {"elev": 7.5}) and n.where("id = 'b'").first()["size"] == 1 and e.count() == 2 and e.first().weight == 9
    with pytest.raises(importers.GraphFormatError):
        importers.import_geojson(spark, put(tmp_path, "h.json", geo.replace("[3,4]]", "[3,5]]")))


def test_export(spark, tmp_path):
    labelled = spark.createDataFrame([(0, "L1", "A", "B"), (1, "L1", "", "")], "ind int, locus string, left string, right string")
    people = spark.createDataFrame([(0, "i10"), (1, "i2")], "ind int, name string")
    strata = spark.createDataFrame([(0, "p"), (1, "p")], "ind int, stratum string")
    rows = exporters.genotype_rows(labelled, people, strata, ["L1"])
    assert [tuple(r) for r in rows.collect()] == [("p", "i2", ":"), ("p", "i10", "A:B")]
    exporters.export_genotypes(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    s = store.ProjectStore.create(spark, path)
    with pytest.raises(store.AlreadyExists):
        store.ProjectStore.create(spark, path)
    with pytest.raises(store.NotFound):
        store.ProjectStore.open(spark, str(tmp_path / "none"))
    people = spark.createDataFrame([(0, "i1", 1.0, 2.0), (1, "i2", None, None)], store.SCHEMAS["geneticData"]["individuals"])
    loci = spark.createDataFrame([(0, "L", "c", 5, "biallelicSNP", "observed")], store.SCHEMAS["geneticData"]["loci"])
    g = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 0)], "ind_ord int, locus_ord int, a1 int, a2 int")
    fam, kids = spark.createDataFrame([("f", 0, 0)], store.SCHEMAS["geneticData"]["families"]), spark.createDataFrame([("f", 1, 0)], store.SCHEMAS["geneticData"]["family_offspring"])
    assert s.read_parentage() is None
    s.write_genetics(individuals=people, loci=loci, genotypes=g, families=fam, family_offspring=kids)
    assert s.read_genetics()["individuals"].count() == 2 and s.read_parentage()[0].count() == 1
    nodes = spark.createDataFrame([(0, "n0", "a", 1.0, None, None), (1, "n1", "b", 1.0, None, None)], store.SCHEMAS["graph"]["nodes"])
    edges = spark.createDataFrame([(0, "e", 0, 1, 2.5)], store.SCHEMAS["graph"]["edges"])
    s.write_graph(nodes=nodes, edges=edges, graph_loci=spark.createDataFrame([(0,)], "locus_ord int"))
    assert s.read_graph()[1].first().dst == "n1" and s.read_graph_loci().first().name == "L"
    with pytest.raises(store.UnknownReference):
        s.write_graph(nodes=nodes, edges=edges.withColumn("to_ord", F.lit(9)))
    with pytest.raises(store.InvalidValue):
        s.write_graph(nodes=nodes.withColumn("latitude", F.lit(1.0)), edges=edges)
    one = s.add_result("r", "body", NOW)
    s.attach_image(one, "plot", b"1")
    s.attach_image(one, "plot", b"22")
    assert bytes(s.image(one, "plot").first().data) == b"22" and s.results().count() == 1 and s.result(one).first().body == "body"
    with pytest.raises(store.UnknownReference):
        s.attach_image("no", "plot", b"")
    s.add_matrix("m", b"old", NOW)
    s.add_matrix("m", b"new", NOW)
    assert bytes(s.latest_matrix().first().data) == b"new" and [r.ordinal for r in s.matrices().collect()] == [0, 1]
    s.append_log("info", "hello", NOW)
    assert s.log_entries().first().message == "hello"
    assert s.sql("select count(*) as n from individuals where name = :n", n="i1").first().n == 1
    summary = s.summary()
    assert (summary.individuals, summary.markers, summary.families, summary.nodes, summary.matrices) == (2, "biallelicSNP", 1, 2, 2)
    copy = s.snapshot(str(tmp_path / "copy"))
    assert set(copy.components()) == set(store.SCHEMAS) and copy.load_snapshot()["matrices"]["matrices"].count() == 1
    small = store.ProjectStore.open_or_create(spark, str(tmp_path / "t"), ("log",))
    assert small.summary().individuals is None and small.components() == ["log"]
    with pytest.raises(store.MissingComponent):
        small.results()
    small.close()


def test_staging_tables(spark):
    people = spark.createDataFrame([(0, "b10", None, None), (1, "b2", None, None)], store.SCHEMAS["geneticData"]["individuals"])
    g = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 0)], "ind_ord int, locus_ord int, a1 int, a2 int")
    loci = spark.createDataFrame([(0, "L10", "c10", 5, "biallelicSNP", "observed"), (1, "L2", "c2", 9, "biallelicSNP", "observed")], store.SCHEMAS["geneticData"]["loci"])
    strata = spark.createDataFrame([(0, "pop", "x", "P")], store.SCHEMAS["geneticData"]["individual_strata"])
    assert store.add_individual(people, "c").agg(F.max("ind_ord")).first()[0] == 2 and store.add_locus(loci, "L3").count() == 3
    fewer, moved = store.delete_individual(people, g, 0)
    assert fewer.first().ind_ord == 0 and moved.first().a2 == 0
    assert [r.name for r in store.naturally(people).collect()] == ["b2", "b10"] and [r.name for r in store.loci_in_order(loci).collect()] == ["L2", "L10"]
    assert store.members(people, strata, "pop", "P").count() == 1 and store.strata_of(strata, 0).count() == 1 and store.genotypes_in(g, strata, "pop", "P", 0).count() == 1
    assert store.genotypes_at(people, g.where("ind_ord = 0"), 0).where("a1 = 0").count() == 1 and store.genotypes_of(g, 1).count() == 1
    assert [r.name for r in store.locus_names(g, loci).collect()] == ["L10"] and store.locus_index(loci, "L2").first().locus_ord == 1 and store.locus_index(loci, "no").count() == 0
    assert store.set_genotypes(g, g.where("ind_ord = 0").withColumn("a1", F.lit(9))).agg(F.max("a1")).first()[0] == 9 and store.add_strata(strata, strata).count() == 1
    assert store.markers_for_matrix(g, loci).where("ind_ord = 1").first().a1 == 0 and store.index_strata(strata, "pop").first().stratum == "P"
    assert store.update_rows(people, people.where("ind_ord = 1").withColumn("name", F.lit("new")), "ind_ord").where("name = 'new'").count() == 1 and store.named(people, "b2").count() == 1


def test_streaming_counts(spark, tmp_path):
    schema = "ts timestamp, locus int, a1 int, a2 int, sign int"
    rows = [(NOW, 0, 1, 2, 1), (NOW, 0, 1, 0, 1), (NOW, 0, 1, 2, -1), (NOW + datetime.timedelta(days=3), 0, 2, 2, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.running_counts(read()).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.locus, r.allele): r.n for r in spark.table("counts").collect()} == {(0, 1): 1, (0, 2): 2}
    q = streaming.windowed_counts(read()).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    time.sleep(0.1)
    q.stop()
    assert {(r.allele, r.n) for r in spark.table("windows").collect()} == {(1, 1), (2, 0)}
