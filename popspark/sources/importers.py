"""Readers of genotype tables and graphs.

Covers S1-S14. Errors in the data are found by small probes before anything is
returned, and raised as typed errors. Text files keep their line numbers, so results
that depend on first appearance do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popspark.operators.frequencies import codebook, encode
from popspark.operators.stages import numbered, saved


class DataError(ValueError):
    """The base of data errors."""


class EmptyInput(DataError):
    pass


class MissingColumn(DataError):
    pass


class MalformedGenotype(DataError):
    pass


class DuplicateMother(DataError):
    pass


class SideFileMismatch(DataError):
    pass


class InvalidDosageCode(DataError):
    pass


class GraphFormatError(DataError):
    """A graph file's error, with its 1-based line where there is one."""

    def __init__(self, what: str, line: int | None = None):
        super().__init__(what if line is None else f"line {line}: {what}")
        self.line = line


@dataclass(frozen=True)
class PopulationLayout:
    """Which columns of a population table mean what (S3); loci default to all others."""

    strata: tuple[str, ...]
    name: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    loci: tuple[str, ...] | None = None
    separator: str = ":"


@dataclass(frozen=True)
class FamilyLayout:
    """Which columns of a family table mean what."""

    family: str = "momID"
    offspring: str = "OffspringID"
    mother_mark: str = "0"
    separator: str = ":"
    latitude: str | None = None
    longitude: str | None = None
    loci: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Dataset:
    """An imported data set: tables of individuals, loci, codebooks, genotypes, strata, families and offspring."""

    individuals: DataFrame
    loci: DataFrame
    codebooks: DataFrame
    genotypes: DataFrame
    strata: DataFrame | None = None
    families: DataFrame | None = None
    offspring: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and text of a text file, or of a folder's files in order of their names.

    Files are read in splits. A line's number is its place in its split after the
    lines of all splits before, which are counted by split; a row a split is all that
    one task sees of the whole. Lines end at newlines; a carriage return before one is
    no part of the text, and a newline at the very end is followed by one empty line.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path, lineSep="\n").select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), meta["file_size"].alias("size"))
    # Rows of a split are numbered in the order in which its task reads them, in the pass that is written.
    rows = saved(read.withColumn("row", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("file", "at", "size").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = Window.partitionBy(F.lit(0)).orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(splits.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "splits")
    lines = rows.join(offsets.select("file", "at", "first", "base"), ["file", "at"]).select((F.col("base") + F.col("row") - F.col("first") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("text"))
    # With the newlines between them, lines are one byte longer than a file that does not end in one (a byte order mark, three bytes, is no text).
    last = offsets.groupBy("file", "size").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    ended = last.agg(F.max(F.struct("file", (F.col("size") - F.col("bytes")).isin(0, 3).alias("closed"))).alias("m"), F.sum("n").alias("n")).where("m.closed")
    # No literal: what is worked out from text must not be worked out for it before it is filtered.
    return lines.unionByName(ended.select((F.col("n") + 1).alias("line"), F.substring("m.file", 1, 0).alias("text")))


def split_csv(spark: SparkSession, path: str) -> DataFrame:
    """line, cells: split at newlines and commas, no quoting; a trailing newline gives a last row with one empty cell."""
    return numbered_lines(spark, path).select("line", F.split("text", ",", -1).alias("cells"))


def read_table(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header and rows (line, one column for each name), cells trimmed, blank lines skipped."""
    cells = split_csv(spark, path)
    head = cells.where("line = 1").first()
    if head is None or not any(c.strip() for c in head.cells):
        raise EmptyInput(path)
    names = [c.strip() for c in head.cells]
    rows = cells.where("line > 1").where(F.exists("cells", lambda c: F.trim(c) != ""))
    out = rows.select("line", *[F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)])
    if not out.limit(1).count():
        raise EmptyInput(path)
    return names, out


def _need(names: list[str], wanted: list[str | None]) -> None:
    for w in wanted:
        if w is not None and w not in names:
            raise MissingColumn(w)


def _cells(rows: DataFrame, loci: list[str], separator: str) -> DataFrame:
    """ind, locus_ord, locus, left, right: one side for a haploid, none for an empty cell; more is an error."""
    melted = rows.select("ind", F.posexplode(F.array(*[F.struct(F.lit(n).alias("locus"), F.col(f"`{n}`").alias("cell")) for n in loci])).alias("locus_ord", "c"))
    cells = melted.select("ind", "locus_ord", "c.locus", "c.cell", F.split("c.cell", f"\\Q{separator}\\E", -1).alias("sides"))
    bad = cells.where(F.size("sides") > 2).first()
    if bad is not None:
        raise MalformedGenotype(f"{bad.locus} of row {bad.ind}: {bad.cell}")
    side = lambda i: F.trim(F.coalesce(F.get("sides", F.lit(i)), F.lit("")))
    return cells.select("ind", "locus_ord", "locus", side(0).alias("left"), side(1).alias("right"))


def _coordinates(latitude: str | None, longitude: str | None) -> list:
    number = lambda c: F.expr(f"try_cast(`{c}` as double)") if c else F.lit(None).cast("double")
    return [number(latitude).alias("latitude"), number(longitude).alias("longitude")]


def _assemble(cells: DataFrame, individuals: DataFrame, **more) -> Dataset:
    book = codebook(cells, "locus_ord", "ind", "left", "right")
    loci = cells.select("locus_ord", F.col("locus").alias("name")).distinct().withColumn("marker_type", F.lit("microsatellite")).withColumn("provenance", F.lit("observed"))
    return Dataset(individuals, loci, book, encode(cells, book, "locus_ord", "ind", "left", "right"), **more)


def import_population_table(spark: SparkSession, path: str, layout: PopulationLayout) -> Dataset:
    """A population CSV."""
    names, rows = read_table(spark, path)
    meta = [*layout.strata, layout.name, layout.latitude, layout.longitude]
    _need(names, [*meta, *(layout.loci or ())])
    loci = list(layout.loci) if layout.loci is not None else [n for n in names if n not in meta]
    rows = rows.withColumn("ind", (F.col("line") - F.lit(2)).cast("int"))
    title = F.col(f"`{layout.name}`") if layout.name else F.concat(F.lit("row_"), F.col("ind").cast("string"))
    individuals = rows.select("ind", title.alias("name"), *_coordinates(layout.latitude, layout.longitude))
    levels = F.array(*[F.struct(F.lit(s).alias("level"), F.col(f"`{s}`").alias("stratum")) for s in layout.strata])
    strata = rows.select("ind", F.explode(levels).alias("s")).select("ind", "s.level", "s.stratum").where("stratum <> ''")
    return _assemble(_cells(rows, loci, layout.separator), individuals, strata=strata)


def import_family_table(spark: SparkSession, path: str, layout: FamilyLayout = FamilyLayout()) -> Dataset:
    """A family CSV: a row marked as mother, then her offspring; families in order of first appearance."""
    names, rows = read_table(spark, path)
    meta = [layout.family, layout.offspring, layout.latitude, layout.longitude]
    _need(names, [*meta, *(layout.loci or ())])
    loci = list(layout.loci) if layout.loci is not None else [n for n in names if n not in meta]
    rows = rows.withColumn("ind", (F.col("line") - F.lit(2)).cast("int")).withColumn("family", F.col(f"`{layout.family}`")).withColumn("kid", F.col(f"`{layout.offspring}`"))
    is_mother = F.col("kid") == layout.mother_mark
    double = rows.where(is_mother).groupBy("family").count().where("count > 1").first()
    if double is not None:
        raise DuplicateMother(double.family)
    families = rows.groupBy("family").agg(F.min("ind").alias("first"), F.max(F.when(is_mother, F.col("ind"))).alias("mother"))
    families = numbered(families, ["first"], "family_order").select("family", F.col("family_order").cast("int").alias("family_order"), "mother")
    offspring = rows.where(~is_mother).select("family", F.col("ind").alias("offspring"), (F.row_number().over(Window.partitionBy("family").orderBy("ind")) - 1).alias("place"))
    individuals = rows.select("ind", F.concat_ws("-", "family", "kid").alias("name"), *_coordinates(layout.latitude, layout.longitude))
    return _assemble(_cells(rows, loci, layout.separator), individuals, families=families, offspring=offspring)


def import_dosage_triplet(spark: SparkSession, path: str) -> Dataset:
    """path (rows of an index and dosages -1..2), path.indv and path.pos (S6); code = dosage + 1, alleles Z and z as placeholders."""
    lines = lambda p: numbered_lines(spark, p).where(F.trim("text") != "")
    rows, names, places = lines(path), lines(f"{path}.indv"), lines(f"{path}.pos")
    n, m, loci = rows.count(), names.count(), places.count()
    if not n:
        raise EmptyInput(path)
    if n != m:
        raise SideFileMismatch(f"{n} rows, {m} names")
    cells = rows.select((F.col("line") - 1).alias("ind"), F.slice(F.split("text", "\t"), 2, 1 << 30).alias("d"))
    odd = cells.where(F.size("d") != loci).first()
    if odd is not None:
        raise SideFileMismatch(f"row {odd.ind}: {len(odd.d)} dosages, {loci} positions")
    long = cells.select("ind", F.posexplode("d").alias("locus", "dosage"))
    bad = long.where(~F.col("dosage").isin("-1", "0", "1", "2")).first()
    if bad is not None:
        raise InvalidDosageCode(f"{bad.dosage} at row {bad.ind}, locus {bad.locus}")
    code = F.col("dosage").cast("int") + 1
    a1 = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    a2 = F.when(code == 0, 0).when(code == 1, 1).otherwise(2)
    parts = F.split("text", "\t")
    table = places.select((F.col("line") - 1).alias("locus_ord"), F.concat_ws(":", parts[0], parts[1]).alias("name"), parts[0].alias("contig"), parts[1].cast("long").alias("location")).withColumn("marker_type", F.lit("biallelicSNP")).withColumn("provenance", F.lit("refAltPlaceholder"))
    book = table.select(F.col("locus_ord").alias("locus"), F.explode(F.array(*[F.struct(F.lit(i).alias("allele_index"), F.lit(x).alias("label")) for i, x in ((1, "Z"), (2, "z"))])).alias("b")).select("locus", "b.*")
    individuals = names.select((F.col("line") - 1).alias("ind"), F.trim("text").alias("name"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    return Dataset(individuals, table, book, long.select("ind", "locus", a1.alias("a1"), a2.alias("a2")), extra={"dosage": long.select("ind", "locus", F.nullif(code, F.lit(0)).alias("code"))})


def import_graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the text format: a line of two counts, node lines (name size group), edge lines (from to weight)."""
    rows = numbered_lines(spark, path).select("line", F.array_remove(F.split("text", "[ \t]+"), "").alias("p")).where(F.size("p") > 0)
    head = rows.orderBy("line").first()
    if head is None:
        raise GraphFormatError("empty input")
    if len(head.p) != 2 or not all(x.isdigit() for x in head.p):
        raise GraphFormatError("the header must be two counts", head.line)
    n, m = map(int, head.p)
    # Place among the lines with content.
    ranked = numbered(rows, ["line"], "k", -1).where("k >= 0")
    have = ranked.count()
    if have < n + m:
        raise GraphFormatError(f"{n} nodes and {m} edges promised, {have} lines found")
    number = lambda i: F.expr(f"try_cast(p[{i}] as double)")
    of = ranked.where(F.col("k") < n)
    bad = of.where((F.size("p") != 3) | number(1).isNull()).first() if n else None
    if bad is not None:
        raise GraphFormatError("a node is a name, a size and a group", bad.line)
    nodes = of.select(F.col("p")[0].alias("id"), F.col("k").cast("int").alias("ordinal"), number(1).alias("size"), F.col("p")[2].alias("group"))
    arcs = ranked.where((F.col("k") >= n) & (F.col("k") < n + m))
    bad = arcs.where((F.size("p") != 3) | number(2).isNull()).first() if m else None
    if bad is not None:
        raise GraphFormatError("an edge is two names and a weight", bad.line)
    each = arcs.select("line", (F.col("k") - n).alias("e"), F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), number(2).alias("w"))
    known = nodes.select("id")
    lost = each.join(known, each["a"] == known["id"], "left_anti").unionByName(each.join(known, each["b"] == known["id"], "left_anti")).first()
    if lost is not None:
        raise GraphFormatError(f"unknown node in {lost.a} {lost.b}", lost.line)
    return nodes, _both_ways(each)


def _both_ways(each: DataFrame) -> DataFrame:
    """Symmetric edges (e, a, b, w) as two rows each."""
    pair = F.array(F.struct((2 * F.col("e")).alias("edge_ord"), F.col("a").alias("src"), F.col("b").alias("dst")), F.struct((2 * F.col("e") + 1).alias("edge_ord"), F.col("b").alias("src"), F.col("a").alias("dst")))
    return each.select("w", F.explode(pair).alias("x")).select(F.col("x.edge_ord").cast("int").alias("edge_ord"), "x.src", "x.dst", F.col("w").alias("weight"))


def import_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a FeatureCollection: points are nodes, two-point lines symmetric edges between equal coordinates.

    A point needs a name; size is 1 unless given; other properties become the
    categorical or, if numbers, the continuous attributes.
    """
    text = spark.read.text(path, wholetext=True)
    schema = "type string, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    parsed = text.select(F.from_json("value", schema).alias("g"), F.col("value").alias("raw"))
    if parsed.where((F.col("g.type") != "FeatureCollection") | F.col("g.features").isNull()).limit(1).count():
        raise GraphFormatError("not a FeatureCollection")
    f = parsed.select(F.posexplode("g.features").alias("at", "f")).select("at", "f.geometry.type", "f.geometry.coordinates", "f.properties")
    points = f.where("type = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>"))
    if points.where(F.col("properties.name").isNull()).limit(1).count():
        raise GraphFormatError("a point without a name")
    rest = F.map_filter("properties", lambda k, v: ~k.isin("name", "size", "color", "marker-color") & v.isNotNull())
    numeric = lambda v: v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")
    # Numbers given as JSON strings can't be told from numbers once in a map of text; both are continuous here.
    nodes = numbered(points, ["at"], "ordinal").select(
        F.col("properties.name").alias("id"), F.col("ordinal").cast("int").alias("ordinal"),
        F.coalesce(F.expr("try_cast(properties['size'] as double)"), F.lit(1.0)).alias("size"), F.col("properties.color").alias("color"),
        F.col("c")[0].alias("longitude"), F.col("c")[1].alias("latitude"),
        F.map_filter(rest, lambda k, v: ~numeric(v)).alias("categorical"), F.transform_values(F.map_filter(rest, lambda k, v: numeric(v)), lambda k, v: v.cast("double")).alias("continuous"),
    )
    lines = f.where("type = 'LineString'").withColumn("c", F.from_json("coordinates", "array<array<double>>"))
    if lines.where(F.size("c") != 2).limit(1).count():
        raise GraphFormatError("a line must have two points")
    lines = numbered(lines, ["at"], "e").select("e", *[F.col("c")[i][j].alias(n) for i, j, n in ((0, 0, "x1"), (0, 1, "y1"), (1, 0, "x2"), (1, 1, "y2"))], F.coalesce(F.expr("try_cast(properties['weight'] as double)"), F.lit(1.0)).alias("w"))
    a = nodes.select(F.col("id").alias("a"), F.col("longitude").alias("x1"), F.col("latitude").alias("y1"))
    b = nodes.select(F.col("id").alias("b"), F.col("longitude").alias("x2"), F.col("latitude").alias("y2"))
    joined = lines.join(a, ["x1", "y1"], "left").join(b, ["x2", "y2"], "left")
    if joined.where("a is null or b is null").limit(1).count():
        raise GraphFormatError("a line ends where no point is")
    return nodes, _both_ways(joined.select("e", "a", "b", "w"))


#: Loaders of named example data sets, added by the caller.
EXAMPLES: dict[str, tuple] = {}


def load_example(spark: SparkSession, name: str) -> Dataset:
    """A registered example: EXAMPLES[name] = (loader, path, layout)."""
    loader, path, layout = EXAMPLES[name]
    return loader(spark, path, layout) if layout is not None else loader(spark, path)
