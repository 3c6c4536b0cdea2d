"""Reading event tables: by suffix, as Spark tables.

CSV, GeoJSON and Parquet are read by Spark itself, in parallel.  Excel,
shapefile and GeoPackage files are single-file formats: Spark lists them and
hands each file's bytes to one task, so a folder of them is read in parallel
on any file system Spark knows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import PRJ, Projection, parse_projection, to_wgs84
from ..functions.geometry import GEOMETRY, is_line
from ..functions.keys import to_number
from ..operators.numbering import kept
from ..operators.report import geometry_bounds
from ..plans.schema import ALIASES, col
from . import formats, shapes, splits

ROUTE_NAMES = {a.lower() for a in ALIASES["roadway"]}


def suffix(path: str) -> str:
    """What follows the last dot of a path's last name; empty without one."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def infer_numbers(df: DataFrame, keep: set[str] = ROUTE_NAMES) -> DataFrame:
    """Text columns whose every non-blank value is a number become doubles;
    blank text becomes null.  Route ids stay as they are written."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c.lower() not in keep]
    if not texts:
        return df
    blank = lambda c: F.trim(col(c)) == ""
    odd = [F.count_if(~blank(c) & to_number(col(c)).isNull()).alias(f"o{n}") for n, c in enumerate(texts)]
    some = [F.count_if(~blank(c)).alias(f"s{n}") for n, c in enumerate(texts)]
    seen = df.agg(*odd, *some).first()
    value = {c: to_number(col(c)) if not seen[f"o{n}"] and seen[f"s{n}"] else F.when(~blank(c), col(c)) for n, c in enumerate(texts)}
    return df.withColumns(value)


#: Doubled quotes; fields in quotes may hold line breaks.
_CSV = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """Quoted fields with doubled quotes, headers trimmed; all text at first.
    Lines that hold only blanks are left out.  Many tasks read a file: by lines
    where no field holds a line break (one job finds out), else by records
    (``splits``); files with such fields whose lines end in \\r alone are read by
    a task each."""
    names = spark.read.csv(path, header=True, multiLine=True, **_CSV).columns
    lines = spark.read.text(path)
    opens = splits.leaves_open(F.col("value"))[0]
    if lines.where(opens).isEmpty():
        df = spark.read.schema(_texts(names)).csv(path, header=True, **_CSV)
    elif not _only_returns(spark, path).isEmpty():
        df = spark.read.csv(path, header=True, multiLine=True, **_CSV)
    else:
        fields = F.from_csv("text", _texts([f"c{n}" for n in range(len(names))]), {**_CSV, "multiLine": "true"})
        rows = splits.csv_records(spark, path).where("record > 1").select(fields.alias("r"))
        df = rows.select("r.*")
    df = df.toDF(*[c.strip().lstrip("\ufeff") for c in names])
    return infer_numbers(df) if numbers else df


def _texts(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _only_returns(spark: SparkSession, path: str) -> DataFrame:
    """Files with \\r within their only line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.rtrim("value").rlike(r"\r.").alias("inside"))
    return lines.groupBy("file").agg(F.count("*").alias("n"), F.bool_or("inside").alias("inside")).where("n = 1 and inside")


#: A feature's geometry, with coordinates as text: their nesting varies.
_FEATURE = "type string, properties string, geometry struct<type string, coordinates string, geometries string>"


def _parts(kind, coordinates):
    """GeoJSON coordinates as parts of vertices, by geometry type."""
    place = "array<double>"
    read = lambda shape: F.from_json(coordinates, shape)
    ring = lambda points: F.transform(points, lambda p: F.struct(*[F.get(p, F.lit(n)).alias(c) for n, c in enumerate("xyzm")]))
    one, line, many = read(place), read(f"array<{place}>"), read(f"array<array<{place}>>")
    polygons = F.flatten(read(f"array<array<array<{place}>>>"))
    nested = F.when(kind == "Point", F.array(F.array(one))).when(kind.isin("LineString", "MultiPoint"), F.array(line)).when(kind.isin("MultiLineString", "Polygon"), many)
    return F.transform(nested.when(kind == "MultiPolygon", polygons), ring)


def _geometry(g):
    """A geometry struct from that of GeoJSON, its coordinates as text; collections
    become their lines.  ``g`` is a column that is there: it is named often."""
    listed = F.from_json(g["geometries"], "array<struct<type:string,coordinates:string>>")
    lines = F.flatten(F.transform(F.filter(listed, lambda x: x["type"].isin("LineString", "MultiLineString")), lambda x: _parts(x["type"], x["coordinates"])))
    plain = F.struct(g["type"].alias("type"), _parts(g["type"], g["coordinates"]).alias("parts"))
    joined = F.struct(F.lit("MultiLineString").alias("type"), lines.alias("parts"))
    return F.when(g["type"] == "GeometryCollection", F.when(F.size(lines) > 0, joined)).when(g["type"].isNotNull(), plain)


def read_geojson(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """A FeatureCollection, one feature, or a bare geometry per file: a row per
    feature, properties as columns.  A collection is read by many tasks
    (``splits``); a file without features is one text."""
    texts, files = splits.feature_texts(spark, path)
    # read more than once: for names, for numbers in text, then as rows
    listed = kept(_parsed(texts, "text", "type string, properties map<string,string>, geometry string").where("type = 'Feature'").select("file", "properties", "geometry"))
    # summed, not joined: a join would be planned over the rows, before they are one a file
    seen = files.select("file", F.lit(0).alias("n")).unionAll(listed.select("file", F.lit(1).alias("n"))).groupBy("file").agg(F.max("n").alias("n"))
    rest = [unquote(r[0]) for r in seen.where("n = 0").collect()]
    rows = listed.drop("file")
    if rest:
        rows = rows.unionAll(_of_texts(spark.read.text(rest, wholetext=True)))
    return _as_table(rows, numbers)


def _features(files: DataFrame, numbers: bool) -> DataFrame:
    """The features of texts in ``value``."""
    return _as_table(_of_texts(files), numbers)


def _of_texts(files: DataFrame) -> DataFrame:
    top = F.from_json("value", "type string, features array<string>, properties string, geometry string")
    features = files.select("value", top.alias("t"))
    feature = F.when(F.col("t.type") == "FeatureCollection", F.col("t.features")).when(F.col("t.type") == "Feature", F.array("value"))
    bare = F.array(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("value"), F.lit("}")))
    rows = features.select(F.explode(F.coalesce(feature, bare)).alias("f"))
    return _parsed(rows, "f", "properties map<string,string>, geometry string").select("properties", "geometry")


def _parsed(rows: DataFrame, text: str, shape: str) -> DataFrame:
    """With the fields of a JSON text as columns.  A text is parsed once: taken from
    ``from_json`` by name, each field would be parsed for apart."""
    return rows.select("*", F.inline(F.array(F.from_json(text, shape))))


def _as_table(rows: DataFrame, numbers: bool) -> DataFrame:
    """Properties (of all rows) as columns, then the geometry."""
    names = [r[0] for r in rows.select(F.explode(F.map_keys("properties"))).distinct().sort("col").collect()]
    shaped = _parsed(rows.withColumnRenamed("geometry", "__text"), "__text", "type string, coordinates string, geometries string")
    g = F.struct("type", "coordinates", "geometries")
    df = shaped.select(*[F.col("properties").getItem(n).alias(n) for n in names], _geometry(g).alias("geometry"))
    return infer_numbers(df) if numbers else df


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def _bytes(cell: pa.BinaryScalar) -> bytes | None:
    return cell.as_buffer().to_pybytes() if cell.is_valid else None


def _read_files(files: DataFrame, header: Callable[..., T.StructType], rows: Callable[..., Iterator[dict]]) -> DataFrame:
    """Each row of ``files`` (path, bytes of one or several files) in one task.
    The table has the columns of all files, in the order in which they first
    come; a column of several types is text."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(*map(_bytes, cells)).json() for cells in zip(*batch.columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "fields"])

    # one row per different header
    seen = files.mapInArrow(headers, "path string, fields string").groupBy("fields").agg(F.min("path").alias("path")).orderBy("path").collect()
    if not seen:
        raise FileNotFoundError("no file with content")
    kinds: dict[str, T.DataType] = {}
    for r in seen:
        for field in T.StructType.fromJson(json.loads(r.fields)):
            known = kinds.setdefault(field.name, field.dataType)
            kinds[field.name] = known if known == field.dataType else T.StringType()
    # the geometry comes last
    names = sorted(kinds, key=lambda n: n == "geometry")
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    texts = {n for n in names if kinds[n] == T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*batch.columns):
                held = []
                for row in rows(*map(_bytes, cells), schema):
                    held.append(row)
                    if len(held) == 4096:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    def made(held: list[dict]) -> pa.RecordBatch:
        value = lambda r, n: str(r[n]) if n in texts and r.get(n) is not None else r.get(n)
        return pa.RecordBatch.from_arrays([pa.array([value(r, f.name) for r in held], _arrow_type(f.dataType)) for f in schema], names=schema.names)

    return files.drop("path").mapInArrow(run, schema)


def read_excel(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """The first sheet; all cells as text, then numbers where they all are."""
    df = _read_files(_files(spark, path), formats.xlsx_schema, formats.xlsx_rows)
    return infer_numbers(df) if numbers else df


def read_zip(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """What the archives hold: GeoJSON, else CSV (or .txt), else Excel, else a
    shapefile; archives inside are opened.  All must hold the same kind."""
    files = _files(spark, path)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([formats.archive_kind(_bytes(x)) for x in batch.column("content")], pa.string())], ["kind"])

    found = sorted(r.kind for r in files.mapInArrow(kinds, "kind string").distinct().collect())
    if len(found) != 1:
        raise ValueError(f"archives of one kind are read together, not {', '.join(found) or 'none'}")
    if found == ["shp"]:
        return read_shapefile(spark, path)
    if found == ["geojson"]:

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = [formats.archive_member(_bytes(x), "geojson").decode("utf-8-sig") for x in batch.column("content")]
                yield pa.RecordBatch.from_arrays([pa.array(inside, pa.string())], ["value"])

        return _features(files.mapInArrow(texts, "value string"), numbers)
    header, rows = (formats.zipped_csv_schema, formats.zipped_csv_rows) if found == ["csv"] else (formats.zipped_xlsx_schema, formats.zipped_xlsx_rows)
    df = _read_files(files, header, rows)
    return infer_numbers(df) if numbers else df


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Zipped shapefiles (.shp and .dbf in one archive)."""
    return _read_files(_files(spark, path), formats.shapefile_schema, formats.shapefile_rows)


def _siblings(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(stem, content) of the files beside ``path`` that end so, case aside."""
    folder = path.rpartition("/")[0] or "."
    letters = "".join(f"[{c}{c.upper()}]" for c in ending)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{letters}").load(folder).where("length > 0")
    return found.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), "path", "content")


def _named(path: str):
    """Whether a stem is that of the file asked for; the scheme may differ."""
    return F.regexp_replace("stem", "^.*/", "") == F.lit(path.rpartition("/")[2].rpartition(".")[0])


def first_shape(spark: SparkSession, folder: str) -> str:
    """The first .shp of a folder, by name."""
    found = _siblings(spark, folder.rstrip("/") + "/", "shp").agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no .shp in {folder}")
    return found


#: File systems of which a task can read a range by itself.
RANGED = ("file:", "s3:", "gs:")


def read_shape(spark: SparkSession, path: str) -> DataFrame:
    """A bare .shp with the .dbf beside it, if there is one.  With an index
    (.shx) beside it, on a file system of ``RANGED``, many tasks read it
    (``shapes``); else one."""
    beside = {}
    for ending in ("shp", "shx", "dbf"):
        first = _siblings(spark, path, ending).where(_named(path)).agg(F.min("path")).first()[0]
        beside[ending] = first or ""
    if beside["shp"] and beside["shx"] and beside["shp"].startswith(RANGED):
        spark.dataSource.register(shapes.ShapefileSource)
        return spark.read.format("shapefile").options(shx=beside["shx"], dbf=beside["dbf"]).load(beside["shp"])
    shp = _siblings(spark, path, "shp").where(_named(path)).select("stem", "path", F.col("content").alias("shp"))
    dbf = _siblings(spark, path, "dbf").where(_named(path)).select("stem", F.col("content").alias("dbf"))
    return _read_files(shp.join(dbf, "stem", "left").select("path", "shp", "dbf"), formats.shape_schema, lambda shp, dbf, schema: formats.shape_rows(shp, dbf))


def source_crs(spark: SparkSession, path: str) -> str | None:
    """What a spatial file says its coordinates are in: .prj text or a code;
    null if it says nothing.  Of several files the first by name counts."""
    kind = suffix(path)
    if kind in ("zip", "gpkg"):
        read = formats.archive_prj if kind == "zip" else formats.geopackage_crs
        first = _files(spark, path).orderBy("path").first()
        return read(bytes(first.content)) if first else None
    if kind in ("", "shp"):
        shape = path if kind else first_shape(spark, path)
        first = _siblings(spark, shape, "prj").where(_named(shape)).first()
        return bytes(first.content).decode("utf-8", "replace") if first else None
    return None


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """The first feature table of each GeoPackage."""
    return _read_files(_files(spark, path), formats.geopackage_schema, formats.geopackage_rows)


#: Of several files the table is in the first kind that is there.
PRECEDENCE = (("zip",), ("geojson", "json"), ("csv", "txt"), ("xlsx",), ("xls",), ("shp",), ("gpkg",), ("parquet",))


def main_file(paths: list[str]) -> str:
    """Of files chosen together (a shapefile with its parts, say), the one to
    read."""
    for kinds in PRECEDENCE:
        found = sorted(p for p in paths if suffix(p) in kinds)
        if len(found) > 1 and kinds == ("shp",):
            raise ValueError(f"several shapefiles ({', '.join(found)}): one layer at a time")
        if found:
            return found[0]
    raise ValueError("no CSV, Excel, GeoJSON, shapefile, GeoPackage or Parquet file, and no archive of one")


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An event table by its suffix; of a folder without one, its first .shp; of
    several files, the one that ``main_file`` names."""
    path = path if isinstance(path, str) else main_file(path)
    readers = {
        "csv": read_csv, "txt": read_csv, "json": read_geojson, "geojson": read_geojson, "xlsx": read_excel, "zip": read_zip, "shp": read_shape, "gpkg": read_geopackage,
    }
    kind = suffix(path)
    if not kind:
        return read_shape(spark, first_shape(spark, path))
    if kind == "xls":
        raise ValueError("old Excel files (.xls) are not read; save as .xlsx")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}: {', '.join(sorted(readers))}, parquet")
    return readers[kind](spark, path)


def layer_projection(df: DataFrame, crs: str | None = None) -> Projection:
    """The projection that ``crs`` (a code or .prj text) names; without one, by
    one pass over all vertices: degrees if none lies beyond them, else unknown."""
    if crs or "geometry" not in df.columns:
        return parse_projection(crs=crs, first_xy=(1e9, 1e9) if crs else None)
    bounds = geometry_bounds(df).first()
    if bounds.min_x is None:
        return parse_projection()
    return parse_projection(first_xy=(max(-bounds.min_x, bounds.max_x), max(-bounds.min_y, bounds.max_y)))


# ---- writing ----


def _geojson_feature(df: DataFrame):
    """One feature per row, as JSON text."""
    g = F.col("geometry")
    place = lambda v: F.filter(F.array(v["x"], v["y"], F.when(v["m"].isNotNull(), F.coalesce(v["z"], F.lit(0.0))).otherwise(v["z"]), v["m"]), lambda n: n.isNotNull())
    parts = F.transform(g["parts"], lambda p: F.transform(p, place))
    single = {"Point": F.to_json(parts[0][0]), "LineString": F.to_json(parts[0]), "MultiPoint": F.to_json(parts[0])}
    coordinates = F.to_json(parts)
    for kind, text in single.items():
        coordinates = F.when(g["type"] == kind, text).otherwise(coordinates)
    shape = F.when(g.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), coordinates, F.lit("}")))
    columns = [col(c) for c in df.columns if c != "geometry"]
    properties = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), shape, F.lit("}"))


def _flat(df: DataFrame, *more) -> DataFrame:
    """Without geometry, structs, maps and arrays as JSON; and further columns."""
    kept = [c for c in df.columns if c != "geometry"]
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(*[(F.to_json(col(c)) if isinstance(df.schema[c].dataType, nested) else col(c)).alias(c) for c in kept], *more)


def to_csv(df: DataFrame, path: str) -> None:
    """Geometry is left out; structs, maps and arrays are written as JSON.  Text
    keeps the blanks around it."""
    _flat(df).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_geojson(df: DataFrame, path: str, crs: str | None = None, single_file: bool = True) -> None:
    """One FeatureCollection, its features passed on one by one to the task that
    writes it, or with ``single_file=False`` a folder of collections, one a
    task.  No task holds a collection."""
    named = "" if crs is None else f'"crs":{{"type":"name","properties":{{"name":{json.dumps(crs)}}}}},'
    features = df.select(_geojson_feature(df).alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        comma = ""
        yield made(['{"type":"FeatureCollection",' + named + '"features":['])
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield made([f"{',' if n else comma}{text}" for n, text in enumerate(texts)])
            comma = "," if texts else comma
        yield made(["]}"])

    (features.repartition(1) if single_file else features).mapInArrow(framed, "value string").write.text(path)


def to_shapefile(df: DataFrame, path: str, prj: str) -> None:
    """A zipped polyline shapefile of the rows with a line, written locally by the
    driver: the format is one file, so more than ``formats.MOST_ROWS`` such
    rows raise ValueError; none is left out."""
    if "geometry" not in df.columns:
        raise ValueError("a shapefile needs a geometry column")
    lines = df.where(is_line(F.col("geometry")))
    if lines.limit(formats.MOST_ROWS + 1).count() > formats.MOST_ROWS:
        raise ValueError(f"more than {formats.MOST_ROWS} rows with a line: write several parts, GeoJSON or Parquet")
    formats.write_shapefile(path, df.schema, (r.asDict(recursive=True) for r in lines.toLocalIterator()), prj)


def to_shapefiles(df: DataFrame, path: str, prj: str, range_bytes: int = shapes.RANGE_BYTES) -> None:
    """A folder of polyline layers of the rows with a line, written in parallel to
    a file system of ``RANGED``; ``read_shapefiles`` reads them.  One pass finds
    the columns' widths; a text of more than 254 bytes raises ValueError."""
    if "geometry" not in df.columns:
        raise ValueError("a shapefile needs a geometry column")
    lines = _flat(df, F.col("geometry")).where(is_line(F.col("geometry")))
    numeric = {f.name for f in lines.schema if isinstance(f.dataType, T.NumericType)}
    columns = [c for c in lines.columns if c != "geometry"]
    seen = lines.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.octet_length(col(c).cast("string"))).alias(f"w{n}") for n, c in enumerate(columns) if c not in numeric]).first()
    if not seen["n"]:
        raise ValueError("no row has a line geometry")
    # a double has 24 characters at most
    width = {c: 24 if c in numeric else max(1, seen[f"w{n}"] or 0) for n, c in enumerate(columns)}
    long = [c for c in columns if width[c] > formats.TEXT_BYTES]
    if long:
        raise ValueError(f"text of more than {formats.TEXT_BYTES} bytes in {', '.join(long)}: write GeoJSON or Parquet")
    df.sparkSession.dataSource.register(shapes.ShapefileSource)
    texts = [col(c) if c in numeric or c == "geometry" else col(c).cast("string").alias(c) for c in lines.columns]
    lines.select(texts).write.format("shapefile").options(width=json.dumps(width), prj=prj, rangeBytes=range_bytes).mode("append").save(path)


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """All layers of a folder, each read by many tasks."""
    spark.dataSource.register(shapes.ShapefileSource)
    return spark.read.format("shapefile").load(path)


def to_excel(df: DataFrame, path: str) -> None:
    """A workbook written locally by the driver, partition by partition; geometry
    is left out, nested values are JSON.  More rows than a sheet holds raise
    ValueError."""
    if df.limit(formats.SHEET_ROWS).count() >= formats.SHEET_ROWS:
        raise ValueError(f"a sheet holds {formats.SHEET_ROWS - 1} rows: write CSV or Parquet")
    kept = _flat(df)
    formats.write_xlsx(path, kept.columns, kept.toLocalIterator())


def to_geopackage(df: DataFrame, path: str, code: str = "EPSG:4326", wkt: str = "") -> None:
    """One feature table, written locally by the driver, partition by partition:
    the format is one file.  Nested values are JSON."""
    if "geometry" not in df.columns:
        raise ValueError("a GeoPackage needs a geometry column")
    flat = _flat(df, col("geometry"))
    formats.write_geopackage(path, flat.schema, (r.asDict(recursive=True) for r in flat.toLocalIterator()), code, wkt)


#: Names of the spatial formats, and their suffixes.
SPATIAL = {"shapefile": "shp", "shp": "shp", "geojson": "geojson", "json": "geojson", "geopackage": "gpkg", "gpkg": "gpkg"}


def spatial_output(path: str, format: str | None = None) -> str:
    """The path to write, with the suffix of the format where it has no spatial
    one; other formats raise ValueError."""
    wanted = SPATIAL.get((format or suffix(path)).lower())
    if wanted is None:
        raise ValueError("spatial formats: shp, geojson, gpkg")
    if suffix(path) in ("shp", "geojson", "json", "gpkg"):
        return path
    return (path.removesuffix(f".{suffix(path)}") if suffix(path) else path) + f".{wanted}"


def write_events(df: DataFrame, path: str, crs: str | None = None, output_crs: str = "wgs84") -> None:
    """By suffix; spatial formats need a geometry column.

    ``crs`` names what the geometry is in (a code or .prj text; else it is told
    from the vertices).  GeoJSON is always written in WGS 84, a shapefile or
    GeoPackage in WGS 84 or, with ``output_crs="source"``, as it is.  A geometry
    that must be projected and can't be raises ValueError.
    """
    if output_crs not in ("wgs84", "source"):
        raise ValueError("output_crs: wgs84 or source")
    spatial = suffix(path) in ("json", "geojson", "zip", "shp", "gpkg") and "geometry" in df.columns
    p = layer_projection(df, crs) if spatial else parse_projection(crs=crs)
    crs = crs or ("EPSG:4326" if p.kind == "geographic" else "")
    if spatial and p.kind != "geographic" and (output_crs == "wgs84" or suffix(path) in ("json", "geojson")):
        if p.kind == "unknown":
            raise ValueError(f"no way from {p.code} to WGS 84: name the system, or write a shapefile or GeoPackage with output_crs='source'")
        df, crs = df.withColumn("geometry", to_wgs84(F.col("geometry"), p)), "EPSG:4326"
    kind = suffix(path)
    if kind == "csv":
        to_csv(df, path)
    elif kind in ("json", "geojson"):
        if "geometry" not in df.columns:
            raise ValueError("GeoJSON needs a geometry column")
        to_geojson(df, path, crs)
    elif kind in ("zip", "shp"):
        to_shapefile(df, path, PRJ.get(crs, crs if "[" in crs else PRJ["EPSG:4326"] if p.kind == "geographic" else ""))
    elif kind == "gpkg":
        known = p.kind == "geographic" or crs in PRJ
        code = crs if crs in PRJ else "EPSG:4326" if known else ""
        to_geopackage(df, path, code, PRJ.get(code, crs))
    elif kind == "xlsx":
        to_excel(df, path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no writer for .{kind}: csv, xlsx, geojson, zip or shp (a zipped shapefile), gpkg, parquet")


GEOMETRY_TYPE = GEOMETRY
