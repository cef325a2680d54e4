"""A project store: a folder of component tables with a meta table.

A component's state is the newest entry of its commit log: numbered files, each put in
place only if its number is free, that list the folders of which each table is the
union. A writer first writes its rows to new folders, then tries to commit the next
number; if another has taken it, it starts again from that one's state, so no writer's
rows are lost. Appended rows are small folders of their own, which a commit merges once
there are many. A crash leaves at most folders that no entry names. Old versions stay
readable until `vacuum`. Components: geneticData, graph, results, log, matrices.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.functions.text import natural_key
from popspark.operators.stages import numbered

from .files import file_system, put_if_absent, read_text

# Components, their schema version and their tables.
VERSION = 1
SCHEMAS: dict[str, dict[str, str]] = {
    "geneticData": {
        "individuals": "ind_ord int, name string, latitude double, longitude double",
        "loci": "locus_ord int, name string, contig string, location long, marker_type string, allele_provenance string",
        "codebooks": "locus_ord int, allele_index short, label string",
        "genotypes": "ind_ord int, locus_ord int, a1 short, a2 short",
        "individual_strata": "ind_ord int, level string, stratum_id string, stratum_name string",
        "families": "family_id string, family_order int, mother_ord int",
        "family_offspring": "family_id string, offspring_ord int, offspring_order int",
    },
    "graph": {
        "nodes": "node_ord int, id string, name string, size double, latitude double, longitude double",
        "node_strata": "node_ord int, level string, stratum_id string, stratum_name string",
        "node_values": "ordinal int, name string, value double, kind string",
        "edges": "edge_ord int, id string, from_ord int, to_ord int, weight double",
        "edge_values": "ordinal int, name string, value double, kind string",
        "graph_values": "name string, value double",
        "graph_loci": "locus_ord int",
    },
    "results": {
        "results": "ordinal long, id string, name string, description string, body string, created_at timestamp",
        "result_images": "result_id string, name string, mime_type string, width int, height int, data binary",
    },
    "log": {"log_entries": "ordinal long, id string, timestamp timestamp, log_type string, analysis_tag string, message string"},
    "matrices": {"matrices": "ordinal long, id string, name string, description string, created_at timestamp, data binary"},
}


class StoreError(RuntimeError):
    """The base of store errors."""


class AlreadyExists(StoreError):
    pass


class NotFound(StoreError):
    pass


class MissingComponent(StoreError):
    pass


class VersionMismatch(StoreError):
    pass


class UnknownReference(StoreError):
    pass


class InvalidValue(StoreError):
    pass


class Conflict(StoreError):
    """Another writer has taken the version."""


#: Folders of a table that are merged into one, and attempts to commit.
MOST_FOLDERS, ATTEMPTS = 16, 50


@dataclass(frozen=True)
class Summary:
    """What a store holds; null where the component is absent."""

    individuals: int | None
    loci: int | None
    markers: str | None
    families: int | None
    strata_levels: list[str] | None
    nodes: int | None
    edges: int | None
    results: int | None
    log_entries: int | None
    matrices: int | None


class ProjectStore:
    """An open store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs, _ = file_system(spark, self.path)

    # Files

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def _put(self, path: str, text: str) -> None:
        """A small file, whole and only if there is none of the name."""
        if not put_if_absent(self.spark, path, text):
            raise Conflict(path)

    def _get(self, path: str) -> str:
        text = read_text(self.spark, path)
        if text is None:
            raise NotFound(path)
        return text

    def _log(self, component: str) -> str:
        return f"{self.path}/{component}.log"

    def versions(self, component: str) -> list[int]:
        """The component's committed versions, oldest first."""
        if not self._exists(self._log(component)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(self._log(component)))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, component: str, version: int | None = None) -> tuple[int, dict]:
        """The number and content of a version, the newest if none is asked for; (-1, no tables) before the first."""
        known = self.versions(component)
        if not known and version is None:
            return -1, {"version": VERSION, "tables": {}}
        at = known[-1] if version is None else version
        if at not in known:
            raise MissingComponent(f"{component} version {at}")
        return at, json.loads(self._get(f"{self._log(component)}/{at:012d}.json"))

    def _commit(self, component: str, version: int, tables: dict[str, list[str]]) -> None:
        """Put the version in place; Conflict if another is there."""
        self._put(f"{self._log(component)}/{version:012d}.json", json.dumps({"version": VERSION, "tables": tables}))

    def _folder(self, component: str, table: str, df: DataFrame) -> str:
        """Rows written to a new folder, which no version names yet."""
        empty = self.spark.createDataFrame([], SCHEMAS[component][table])
        name = f"{component}-{table}-{uuid.uuid4().hex}"
        df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]).write.parquet(f"{self.path}/{name}")
        return name

    def _change(self, component: str, make: Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> None:
        """Commit what `make` gives for the newest state, again from the start while others commit in between.

        A table of over MOST_FOLDERS folders is merged in a version of its own.
        """
        for _ in range(ATTEMPTS):
            at, entry = self._entry(component)
            try:
                self._commit(component, at + 1, make(dict(entry["tables"])))
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{component}: {ATTEMPTS} attempts")
        at, entry = self._entry(component)
        many = {t: f for t, f in entry["tables"].items() if len(f) > MOST_FOLDERS}
        if many:
            merged = {t: [self._folder(component, t, self._rows(component, t, f))] for t, f in many.items()}
            with contextlib.suppress(Conflict):  # the next writer will merge
                self._commit(component, at + 1, entry["tables"] | merged)

    def _rows(self, component: str, table: str, folders: list[str]) -> DataFrame:
        schema = SCHEMAS[component][table]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self) -> int:
        """Delete the folders that no component's newest version names, and older versions; returns how many folders. No one may be writing."""
        kept: set[str] = set()
        for c in SCHEMAS:
            *old, newest = self.versions(c) or [-1]
            kept |= {f for fs in self._entry(c)[1]["tables"].values() for f in fs}
            for v in old:
                self.fs.delete(self._path(f"{self._log(c)}/{v:012d}.json"), False)
        found = [f.getPath() for f in self.fs.listStatus(self._path(self.path)) if f.isDirectory() and f.getPath().getName().split("-")[0] in SCHEMAS]
        dropped = [p for p in found if p.getName() not in kept]
        for p in dropped:
            self.fs.delete(p, True)
        return len(dropped)

    # Opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, components: tuple[str, ...] = tuple(SCHEMAS)) -> ProjectStore:
        """A new store with empty components."""
        store = cls(spark, path)
        if store._exists(f"{store.path}/meta.json"):
            raise AlreadyExists(path)
        store.fs.mkdirs(store._path(store.path))
        for c in components:
            store.write(c, {})
        try:
            store._put(f"{store.path}/meta.json", json.dumps({"version": VERSION}))
        except Conflict as e:
            raise AlreadyExists(path) from e
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ProjectStore:
        """An existing store; every component's version must match."""
        store = cls(spark, path)
        if not store._exists(f"{store.path}/meta.json"):
            raise NotFound(path)
        for c in store.components():
            found = store._entry(c)[1]["version"]
            if found != VERSION:
                raise VersionMismatch(f"{c}: version {found}, not {VERSION}")
        return store

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, components: tuple[str, ...] = tuple(SCHEMAS)) -> ProjectStore:
        """D4."""
        return cls.open(spark, path) if cls(spark, path)._exists(f"{path.rstrip('/')}/meta.json") else cls.create(spark, path, components)

    def close(self) -> None:
        """Nothing is held open."""

    def components(self) -> list[str]:
        """D1."""
        return [c for c in SCHEMAS if self.versions(c)]

    # Components

    def write(self, component: str, tables: dict[str, DataFrame]) -> None:
        """Replace a component's tables; those not given are empty."""
        made = {t: [self._folder(component, t, df)] for t, df in tables.items() if df is not None and t in SCHEMAS[component]}
        self._change(component, lambda _: made)

    def read(self, component: str, table: str, version: int | None = None) -> DataFrame:
        """A table as it stands, or as it stood in an older version."""
        at, entry = self._entry(component, version)
        if at < 0:
            raise MissingComponent(component)
        return self._rows(component, table, entry["tables"].get(table, []))

    def sql(self, query: str, **args) -> DataFrame:
        """A query with named parameters over this store's tables as views."""
        for c in self.components():
            for t in SCHEMAS[c]:
                self.read(c, t).createOrReplaceTempView(t)
        return self.spark.sql(query, args=args)

    def write_genetics(self, **tables: DataFrame) -> None:
        """D6, D13, D36, E46."""
        self.write("geneticData", tables)

    def read_genetics(self) -> dict[str, DataFrame]:
        """D7, D14, D17, D37."""
        return {t: self.read("geneticData", t) for t in SCHEMAS["geneticData"]}

    def read_parentage(self) -> tuple[DataFrame, DataFrame] | None:
        """Families and offspring in order; null without families."""
        families = self.read("geneticData", "families")
        if not families.limit(1).count():
            return None
        return families.orderBy("family_order"), self.read("geneticData", "family_offspring").orderBy("family_id", "offspring_order")

    def write_graph(self, **tables: DataFrame) -> None:
        """Replace the graph; references to unknown nodes, edges or loci are errors."""
        nodes, edges = tables.get("nodes"), tables.get("edges")

        def check(df: DataFrame | None, column: str, known: DataFrame | None, key: str) -> None:
            if df is not None and (known is None or df.join(known.select(F.col(key).alias("_k")), df[column] == F.col("_k"), "left_anti").limit(1).count()):
                raise UnknownReference(column)

        check(edges, "from_ord", nodes, "node_ord")
        check(edges, "to_ord", nodes, "node_ord")
        check(tables.get("node_values"), "ordinal", nodes, "node_ord")
        check(tables.get("node_strata"), "node_ord", nodes, "node_ord")
        check(tables.get("edge_values"), "ordinal", edges, "edge_ord")
        if "graph_loci" in tables:
            check(tables["graph_loci"], "locus_ord", self.read("geneticData", "loci"), "locus_ord")
        if nodes is not None and nodes.where("(latitude is null) <> (longitude is null)").limit(1).count():
            raise InvalidValue("a node has both coordinates or neither")
        for name in ("node_values", "edge_values"):
            if tables.get(name) is not None and tables[name].where("kind not in ('intrinsic', 'extrinsic')").limit(1).count():
                raise InvalidValue("kind")
        self.write("graph", tables)

    def read_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes, and edges with their ends' ids."""
        nodes, edges = self.read("graph", "nodes"), self.read("graph", "edges")
        a = nodes.select(F.col("node_ord").alias("from_ord"), F.col("id").alias("src"))
        b = nodes.select(F.col("node_ord").alias("to_ord"), F.col("id").alias("dst"))
        return nodes, edges.join(a, "from_ord").join(b, "to_ord").select("edge_ord", "id", "src", "dst", "weight")

    def read_graph_loci(self) -> DataFrame | None:
        """The graph's loci in order; null without genetics."""
        if "geneticData" not in self.components():
            return None
        return self.read("graph", "graph_loci").join(self.read("geneticData", "loci"), "locus_ord").orderBy("locus_ord")

    # Appending: a small folder for the new row; its ordinal follows from the state it is committed upon, so ordinals never clash.

    def next_ordinal(self, component: str, table: str) -> int:
        """W7."""
        return self.read(component, table).agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).first()[0]

    def _append(self, component: str, table: str, row: dict) -> str:
        schema = self.spark.createDataFrame([], SCHEMAS[component][table]).schema
        id = uuid.uuid4().hex
        if not self.versions(component):
            raise MissingComponent(component)

        def make(tables: dict[str, list[str]]) -> dict[str, list[str]]:
            old = tables.get(table, [])
            ordinal = self._rows(component, table, old).agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).first()[0]
            values = {"ordinal": ordinal, "id": id} | row
            one = self.spark.createDataFrame([[values.get(f.name) for f in schema]], schema)
            return tables | {table: [*old, self._folder(component, table, one)]}

        self._change(component, make)
        return id

    def add_result(self, name: str, body: str, created_at, description: str | None = None) -> str:
        """D20."""
        return self._append("results", "results", {"name": name, "body": body, "created_at": created_at, "description": description})

    def results(self) -> DataFrame:
        """In order of insertion."""
        return self.read("results", "results").orderBy("ordinal")

    def result(self, id: str) -> DataFrame:
        """D22."""
        return self.read("results", "results").where(F.col("id") == id)

    def attach_image(self, result_id: str, name: str, data: bytes, mime_type: str = "image/png", width: int | None = None, height: int | None = None) -> None:
        """Insert or replace by (result, name)."""
        if not self.result(result_id).limit(1).count():
            raise UnknownReference(result_id)
        one = self.spark.createDataFrame([(result_id, name, mime_type, width, height, bytearray(data))], SCHEMAS["results"]["result_images"])
        same = (F.col("result_id") == result_id) & (F.col("name") == name)

        def make(tables: dict[str, list[str]]) -> dict[str, list[str]]:
            old = tables.get("result_images", [])
            held = self._rows("results", "result_images", old)
            if held.where(same).isEmpty():
                return tables | {"result_images": [*old, self._folder("results", "result_images", one)]}
            return tables | {"result_images": [self._folder("results", "result_images", held.where(~same).unionByName(one))]}

        self._change("results", make)

    def image(self, result_id: str, name: str) -> DataFrame:
        """D24."""
        return self.read("results", "result_images").where((F.col("result_id") == result_id) & (F.col("name") == name))

    def add_matrix(self, name: str, data: bytes, created_at, description: str | None = None) -> str:
        """D25."""
        return self._append("matrices", "matrices", {"name": name, "data": bytearray(data), "created_at": created_at, "description": description})

    def matrices(self) -> DataFrame:
        """Without their data."""
        return self.read("matrices", "matrices").drop("data").orderBy("ordinal")

    def latest_matrix(self) -> DataFrame:
        """name and the data of its newest row."""
        return self.read("matrices", "matrices").groupBy("name").agg(F.max_by("data", "ordinal").alias("data"))

    def append_log(self, log_type: str, message: str, timestamp, analysis_tag: str | None = None) -> str:
        """D27."""
        return self._append("log", "log_entries", {"log_type": log_type, "message": message, "timestamp": timestamp, "analysis_tag": analysis_tag})

    def log_entries(self) -> DataFrame:
        """D28."""
        return self.read("log", "log_entries").orderBy("ordinal")

    # Whole stores

    def summary(self) -> Summary:
        """Markers are none, one kind, or mixed."""
        have = set(self.components())
        count = lambda c, t: self.read(c, t).count() if c in have else None
        kinds = [r[0] for r in self.read("geneticData", "loci").select("marker_type").distinct().collect()] if "geneticData" in have else None
        levels = [r[0] for r in self.read("geneticData", "individual_strata").select("level").distinct().orderBy(natural_key(F.col("level"))).collect()] if "geneticData" in have else None
        markers = None if kinds is None else "none" if not kinds else kinds[0] if len(kinds) == 1 else "mixed"
        return Summary(count("geneticData", "individuals"), count("geneticData", "loci"), markers, count("geneticData", "families"), levels, count("graph", "nodes"), count("graph", "edges"), count("results", "results"), count("log", "log_entries"), count("matrices", "matrices"))

    def snapshot(self, path: str) -> ProjectStore:
        """A copy with the components that hold rows, whole or not at all."""
        target = path.rstrip("/")
        temporary = f"{target}.{uuid.uuid4().hex}"
        full = [c for c in self.components() if any(self.read(c, t).limit(1).count() for t in SCHEMAS[c])]
        copy = ProjectStore.create(self.spark, temporary, ())
        for c in full:
            copy.write(c, {t: self.read(c, t) for t in SCHEMAS[c]})
        if self._exists(target):
            self.fs.delete(self._path(target), True)
        self.fs.rename(self._path(temporary), self._path(target))
        return ProjectStore.open(self.spark, target)

    def load_snapshot(self) -> dict[str, dict[str, DataFrame]]:
        """All components; of matrices the newest of each name."""
        out = {c: {t: self.read(c, t) for t in SCHEMAS[c]} for c in self.components()}
        if "matrices" in out:
            m = out["matrices"]["matrices"]
            newest = m.groupBy("name").agg(F.max("ordinal").alias("ordinal"))
            out["matrices"]["matrices"] = m.join(newest, ["name", "ordinal"], "left_semi")
        return out


# The staging tables of a data set under construction.


def add_individual(individuals: DataFrame, name: str, latitude: float | None = None, longitude: float | None = None) -> DataFrame:
    """D38."""
    following = individuals.agg(F.coalesce(F.max("ind_ord"), F.lit(-1)) + 1).first()[0]
    return individuals.unionByName(individuals.sparkSession.createDataFrame([(following, name, latitude, longitude)], SCHEMAS["geneticData"]["individuals"]))


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows replaced by those of changes with the same key; unknown keys change nothing."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.join(table.select(key), key, "left_semi").select(table.columns))


def delete_individual(individuals: DataFrame, genotypes: DataFrame, ind: int) -> tuple[DataFrame, DataFrame]:
    """Without the individual, later ordinals moved up by one."""
    move = lambda df: df.where(F.col("ind_ord") != ind).withColumn("ind_ord", F.when(F.col("ind_ord") > ind, F.col("ind_ord") - 1).otherwise(F.col("ind_ord")))
    return move(individuals), move(genotypes)


def add_locus(loci: DataFrame, name: str, contig: str = "", location: int = 0, marker_type: str = "microsatellite") -> DataFrame:
    """D42."""
    following = loci.agg(F.coalesce(F.max("locus_ord"), F.lit(-1)) + 1).first()[0]
    return loci.unionByName(loci.sparkSession.createDataFrame([(following, name, contig, location, marker_type, "observed")], SCHEMAS["geneticData"]["loci"]))


def locus_index(loci: DataFrame, name: str) -> DataFrame:
    """The first locus of that name."""
    return loci.where(F.col("name") == name).agg(F.min("locus_ord").alias("locus_ord")).where("locus_ord is not null")


def named(table: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Rows by name."""
    return table.where(F.col(column) == name)


def set_genotypes(genotypes: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells inserted or replaced."""
    return genotypes.join(changes.select("ind_ord", "locus_ord"), ["ind_ord", "locus_ord"], "left_anti").unionByName(changes.select(genotypes.columns))


def add_strata(strata: DataFrame, more: DataFrame) -> DataFrame:
    """Memberships, each once."""
    return strata.unionByName(more).dropDuplicates(["ind_ord", "level", "stratum_name"])


def members(individuals: DataFrame, strata: DataFrame, level: str, name: str) -> DataFrame:
    """Individuals of a stratum."""
    return individuals.join(strata.where((F.col("level") == level) & (F.col("stratum_name") == name)), "ind_ord", "left_semi")


def strata_of(strata: DataFrame, ind: int) -> DataFrame:
    """J3."""
    return strata.where(F.col("ind_ord") == ind).select("level", "stratum_name")


def genotypes_in(genotypes: DataFrame, strata: DataFrame, level: str, name: str, locus: int | None = None) -> DataFrame:
    """A stratum's genotypes that are there."""
    inside = strata.where((F.col("level") == level) & (F.col("stratum_name") == name))
    rows = genotypes.join(inside, "ind_ord", "left_semi").where("a1 <> 0 or a2 <> 0")
    return rows if locus is None else rows.where(F.col("locus_ord") == locus)


def genotypes_at(individuals: DataFrame, genotypes: DataFrame, locus: int) -> DataFrame:
    """Every individual at a locus, missing ones as (0, 0)."""
    at = genotypes.where(F.col("locus_ord") == locus).select("ind_ord", "a1", "a2")
    return individuals.select("ind_ord").join(at, "ind_ord", "left").select("ind_ord", F.coalesce("a1", F.lit(0)).alias("a1"), F.coalesce("a2", F.lit(0)).alias("a2"))


def genotypes_of(genotypes: DataFrame, ind: int) -> DataFrame:
    """J7."""
    return genotypes.where(F.col("ind_ord") == ind)


def locus_names(genotypes: DataFrame, loci: DataFrame) -> DataFrame:
    """Loci with any allele among the genotypes, in natural order."""
    seen = genotypes.where("a1 <> 0 or a2 <> 0").select("locus_ord").distinct()
    return loci.join(seen, "locus_ord", "left_semi").select("name").distinct().orderBy(natural_key(F.col("name")), "name")


def naturally(table: DataFrame, column: str = "name") -> DataFrame:
    """All rows in natural order of a column."""
    return table.orderBy(natural_key(F.col(column)), column)


def loci_in_order(loci: DataFrame) -> DataFrame:
    """By contig, then location."""
    return loci.orderBy(*_locus_order())


def loci_ranked(loci: DataFrame) -> DataFrame:
    """loci with their rank in that order, from 1."""
    return numbered(loci, _locus_order(), "rank", 1)


def _locus_order() -> list:
    return [natural_key(F.col("contig")), "contig", "location"]


def markers_for_matrix(genotypes: DataFrame, loci: DataFrame) -> DataFrame:
    """Genotypes as the analysis sees them: a haploid at a SNP is missing."""
    kinds = loci.select("locus_ord", "marker_type")
    half = (F.col("marker_type") == "biallelicSNP") & ((F.col("a1") == 0) | (F.col("a2") == 0))
    return genotypes.join(kinds, "locus_ord").select("ind_ord", "locus_ord", *[F.when(half, 0).otherwise(F.col(c)).cast("short").alias(c) for c in ("a1", "a2")])


def index_strata(strata: DataFrame, level: str) -> DataFrame:
    """ind and stratum of one level, as the statistics take them."""
    w = Window.partitionBy("ind_ord").orderBy("stratum_name")
    return strata.where(F.col("level") == level).withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("ind_ord").alias("ind"), F.col("stratum_name").alias("stratum"))
