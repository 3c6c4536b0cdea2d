"""Route lists packed in one text field: unpack to rows, pack again.

A packed field reads ``id = measure | id = begin - end | ...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import union_parts
from ..functions.keys import PadRule, is_missing, measure_text, pad_route_id, to_number
from ..plans.schema import ALIASES, LrsSchema, col, find_column, resolve_roles
from .numbering import numbered

#: Columns that unpacking adds and packing takes away.
WORKING = ("LRS_SUB_ID", "LRS_ROAD_NAME", "LRS_SOURCE_ROW", "ROADWAY_ORIG", "BEGIN_POST_ORIG", "END_POST_ORIG", "LOCATION")


def approaches(packed: Column) -> Column:
    """Array of (roadway, measure, bmp, emp) of a packed text; entries without
    an id sign or a first number are left out."""
    # a step at a time: what a lambda names twice is worked out twice
    number = lambda sides, n: F.trim(F.get(sides, F.lit(n))).try_cast("double")
    known = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    signed = F.transform(F.split(packed.cast("string"), "\\|"), lambda part: F.struct(part.alias("part"), F.instr(part, "=").alias("cut")))
    signed = F.filter(signed, lambda x: x["cut"] > 0)
    # one sign, as a text is cut at a plain character without a regular expression
    cut = lambda x: F.split(F.translate(F.substr(x["part"], x["cut"] + 1), "–,", "--"), "-")
    sides = F.transform(signed, lambda x: F.struct(F.trim(F.substr(x["part"], F.lit(1), x["cut"] - 1)).alias("road"), F.filter(cut(x), lambda s: F.trim(s) != "").alias("sides")))
    read = F.transform(sides, lambda x: F.struct(x["road"].alias("road"), number(x["sides"], 0).alias("first"), number(x["sides"], 1).alias("second")))
    read = F.filter(read, lambda x: (x["road"] != "") & known(x["first"]))
    emp = lambda x: F.when(known(x["second"]), x["second"]).otherwise(x["first"])
    made = F.transform(read, lambda x: F.struct(x["road"].alias("roadway"), x["first"].alias("measure"), x["first"].alias("bmp"), emp(x).alias("emp")))
    return F.when(is_missing(packed), F.array().cast("array<struct<roadway:string,measure:double,bmp:double,emp:double>>")).otherwise(made)


def detect_packed_column(df: DataFrame, sample: int = 50) -> str | None:
    """The packed column by name, else that with the most readable entries in
    the first ``sample`` rows."""
    if named := find_column(df.columns, ALIASES["packed"]):
        return named
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return None
    hits = df.select(*[col(c) for c in texts]).limit(sample).agg(*[F.coalesce(F.sum(F.size(approaches(col(c)))), F.lit(0)).alias(f"h{n}") for n, c in enumerate(texts)]).first()
    best = max(range(len(texts)), key=lambda n: hits[n])
    return texts[best] if hits[best] else None


def explode_routes(
    df: DataFrame,
    packed_col: str | None = None,
    parent_col: str | None = None,
    names_col: str | None = None,
    stub_length: float = 0.02,
    row_col: str | None = None,
    pad: PadRule = PadRule(),
) -> DataFrame:
    """One row per approach, with working columns for ``combine_routes``.

    A point approach gets a stub of ``stub_length`` around it (0: none).
    ``row_col`` numbers the source rows; without it they are numbered from 1 in
    the order in which Spark reads them, which runs a job while the query is
    built and keeps the numbers (``numbering``).  ``names_col=""``
    ignores road names.  Rows without a readable approach are left out;
    geometry is dropped.
    """
    packed_col = packed_col or detect_packed_column(df)
    if not packed_col:
        raise KeyError("no packed route column, such as Intersecting Roadway Id Milepoints")
    parent_col = parent_col or find_column(df.columns, ALIASES["parent"])
    names_col = None if names_col == "" else names_col or find_column(df.columns, ALIASES["names"])
    rows = df.withColumn("__n", col(row_col).cast("long")) if row_col else numbered(df, "__n")
    rows = rows.withColumn("__a", approaches(col(packed_col)))
    rows = rows.select("*", F.posexplode("__a").alias("__k", "__x"))
    stub = (F.col("__x.bmp") == F.col("__x.emp")) & F.lit(stub_length > 0)
    half = stub_length / 2
    parent = F.concat(F.lit("ROW-"), F.col("__n").cast("string"))
    if parent_col:
        parent = F.when(is_missing(col(parent_col)), parent).otherwise(col(parent_col).cast("string"))
    null = F.lit(None).cast("string")
    out: dict[str, Column] = {c: col(c) for c in df.columns if c != "geometry"}
    added = {"ROADWAY_ORIG": col("ROADWAY") if "ROADWAY" in df.columns else null}
    if {"BEGIN_POST", "END_POST"} & {*df.columns}:
        added |= {f"{c}_ORIG": col(c) if c in df.columns else null for c in ("BEGIN_POST", "END_POST")}
    road = F.col("__x.roadway")
    added |= {
        "LRS_SOURCE_ROW": F.col("__n"), "LRS_PARENT_ID": parent, "LRS_SUB_ID": F.col("__k") + 1,
        "ROADWAY": F.coalesce(pad_route_id(road, pad), road), "LOCATION": F.col("__x.measure"),
        "BEGIN_POST": F.when(stub, F.greatest(F.lit(0.0), F.col("__x.measure") - half)).otherwise(F.col("__x.bmp")),
        "END_POST": F.when(stub, F.col("__x.measure") + half).otherwise(F.col("__x.emp")),
    }
    if names_col:
        added["LRS_ROAD_NAME"] = F.trim(F.get(F.split(col(names_col).cast("string"), "\\|"), F.col("__k")))
    return rows.select(*[v.alias(k) for k, v in (out | added).items()])


def combine_routes(
    df: DataFrame, parent_col: str | None = None, sub_col: str = "LRS_SUB_ID", packed_col: str | None = None, keep_parent_id: bool = True,
    drop_working_measures: bool = True, pad: PadRule = PadRule(),
) -> DataFrame:
    """The rows of each source row as one again, its packed text rebuilt.

    Approaches are ordered by sub id, route and measure; one that repeats is
    written once.  Geometries become one line of all parts.  The original
    route and posts return; without original posts the working ones go.
    """
    parent_col = parent_col or ("LRS_SOURCE_ROW" if "LRS_SOURCE_ROW" in df.columns else "LRS_PARENT_ID")
    if parent_col not in df.columns:
        raise KeyError(f"the table lacks {parent_col}; unpack it first")
    packed_col = packed_col or find_column(df.columns, ALIASES["packed"]) or ALIASES["packed"][0]
    has = lambda c: c in df.columns
    given = lambda c, kind: col(c).cast(kind) if has(c) else F.lit(None).cast(kind)
    key = F.struct(given(sub_col, "double").alias("s"), given("ROADWAY", "string").alias("r"), given("LOCATION", "double").alias("m"))
    road = F.coalesce(pad_route_id(given("ROADWAY", "string"), pad), given("ROADWAY", "string"))
    text = F.concat(road, F.lit(" = "), measure_text(F.coalesce(given("LOCATION", "double"), given("BEGIN_POST", "double"))))
    # nulls last, as in the order of rows
    rank = F.struct(*[x for c in ("s", "r", "m") for x in (key[c].isNull(), key[c])])
    names = [c for c in df.columns if c not in WORKING and c not in (packed_col, "geometry") and (c != "LRS_PARENT_ID" or keep_parent_id)]
    if drop_working_measures and not has("BEGIN_POST_ORIG"):
        names = [c for c in names if c not in ("BEGIN_POST", "END_POST")]
    needed = [c for c in df.columns if c in names or c.removesuffix("_ORIG") in names]
    # made before rows are grouped: an aggregate that gathers would evaluate them without compiled code, and carry columns that go
    first = F.struct(F.lit(True), *[col(c).alias(f"c{n}") for n, c in enumerate(needed)])
    rows = df.select(col(parent_col).alias("__p"), F.struct(rank.alias("k"), text.alias("t")).alias("__t"), first.alias("__r"), *([col("geometry").alias("__g")] if has("geometry") else []))
    groups = rows.groupBy("__p").agg(
        F.sort_array(F.collect_set("__t")).alias("__t"),
        F.min_by("__r", F.col("__t.k")).alias("__r"),
        *([F.array_sort(F.collect_list(F.struct(F.col("__t.k").alias("k"), F.col("__g").alias("g")))).alias("__g")] if has("geometry") else []),
    )
    own = lambda c: F.col(f"__r.c{needed.index(c)}")
    out: dict[str, Column] = {}
    for c in names:
        original = f"{c}_ORIG"
        out[c] = F.coalesce(own(original).cast(df.schema[c].dataType), own(c)) if has(original) else own(c)
    out[packed_col] = F.array_join(F.col("__t.t"), "|")
    if has("geometry"):
        out["geometry"] = union_parts(F.transform("__g", lambda x: x["g"]))
    return groups.select(*[v.alias(k) for k, v in out.items()])


def inspect_keys(df: DataFrame, **wanted: str | None) -> DataFrame:
    """One row: usable, missing and inverted rows, packed entries, and what to
    do first (``extract`` if only the packed column can be used, else ``lrs``)."""
    found = resolve_roles(df.columns, wanted)
    line = all(found[r] for r in ("roadway", "bmp", "emp"))
    packed = detect_packed_column(df)
    if line:
        b, e = to_number(col(found["bmp"])), to_number(col(found["emp"]))
        lacks = is_missing(col(found["roadway"])) | b.isNull() | e.isNull()
        kinds = [F.count_if(~lacks & (e >= b)), F.count_if(lacks), F.count_if(~lacks & (e < b))]
    else:
        zero = F.lit(0).cast("long")
        kinds = [zero, F.count(F.lit(1)), zero]
    n = F.size(approaches(col(packed))) if packed else F.lit(0)
    counts = df.agg(
        *[k.alias(a) for k, a in zip(kinds, ("usable", "missing", "inverted"))], F.count_if(n > 0).alias("packed_hits"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("approach_count"),
    )
    first = F.when((F.col("usable") == 0) & F.lit(packed is not None), "extract").otherwise("lrs")
    return counts.withColumns({"has_line_columns": F.lit(line), "packed_col": F.lit(packed).cast("string"), "recommended": first})
