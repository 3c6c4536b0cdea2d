"""Which column plays which part: roles found by alias, on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import PadRule, is_missing, pad_route_id, parse_date, to_number

# Column names under which agencies publish each role, in the
# order in which they are tried.
ALIASES: dict[str, tuple[str, ...]] = {
    "roadway": (
        "ROADWAY", "ROADWAY_ID", "ROADWAYID", "RTE_UNIQUE", "RTE_ID", "RTEID", "ROUTE_ID", "ROUTEID", "LRS_ROUTE", "LRS_ID", "LRS_KEY", "NLFID",
        "RT_ID", "RTID", "ROUTE", "ROUTE_NUM", "ROUTE_NO", "ROUTENUM", "SEG_ID", "SECTION_", "SECTION_ID", "STREET_ID", "Route ID", "Roadway ID",
        "ROADWAY_new", "roadway *",
    ),
    "bmp": (
        "BEGIN_POST", "BEGINMP", "BEGIN_MP", "BEG_MP", "BEGMP", "FROM_MEASURE", "FROMMEASURE", "FROM_MILEPOINT", "FROM_MILEPOST", "FROM_MP",
        "FROMMP", "START_MP", "STARTMP", "BMP", "MinMP", "FROM_MEAS", "BEG_MEAS",
    ),
    "emp": (
        "END_POST", "ENDMP", "END_MP", "TO_MEASURE", "TOMEASURE", "TO_MILEPOINT", "TO_MILEPOST", "TO_MP", "TOMP", "STOP_MP", "EMP", "MaxMP",
        "TO_MEAS", "END_MEAS",
    ),
    "measure": ("LOCATION", "MEASURE", "MEAS", "MILEPOINT", "MILEPOST", "POSTMILE", "MP", "POINT_MP", "EVENT_MP"),
    "offset": ("OFFSET", "LATERAL_OFFSET", "LAT_OFFSET", "OFFSET_FT", "OFFSET_MI"),
    "side": ("SIDE", "LRS_SIDE", "LANE_SIDE", "DIR"),
    "from_date": ("FROM_DATE", "EFF_FROM", "BEGIN_DATE", "START_DATE", "DATE_FROM"),
    "to_date": ("TO_DATE", "EFF_TO", "END_DATE", "DATE_TO"),
    "packed": ("Intersecting Roadway Id Milepoints", "INTERSECTING ROADWAY ID MILEPOINTS", "INTERSECTING_ROADWAY_ID_MILEPOINTS"),
    "names": ("Intersecting Road Names", "INTERSECTING ROAD NAMES"),
    "parent": ("LocationID", "LOCATIONID", "OBJECTID_1", "OBJECTID"),
}
SHORT_ALIASES: dict[str, tuple[str, ...]] = {
    "roadway": ("ROADWAY", "roadway", "Roadway ID", "ROADWAY_ID", "roadwayid", "ROADWAY_new", "SECTION_", "roadway *"),
    "bmp": ("BEGIN_POST", "begin_post", "BMP", "MinMP", "BEGINMP", "BEGIN_MP"),
    "emp": ("END_POST", "end_post", "EMP", "MaxMP", "ENDMP", "END_MP"),
    "measure": ("LOCATION", "location", "MP", "MILEPOST", "milepost"),
}
# Layouts of single agencies.
PROFILES: dict[str, dict[str, tuple[str, ...]]] = {
    "florida": {"roadway": ("ROADWAY", "ROADWAY_ID"), "bmp": ("BEGIN_POST", "BEGIN_MP"), "emp": ("END_POST", "END_MP"), "measure": ("LOCATION", "MILEPOST")},
    "esri": {
        "roadway": ("ROUTE_ID", "ROUTEID", "RouteID"), "bmp": ("FROM_MEASURE", "FromMeasure", "FROM_MILEPOINT"),
        "emp": ("TO_MEASURE", "ToMeasure", "TO_MILEPOINT"), "measure": ("MEASURE", "MEAS"),
    },
    "gdot": {"roadway": ("ROUTE_ID", "ROUTENAME"), "bmp": ("FROM_MILEPOINT", "FROM_MEASURE"), "emp": ("TO_MILEPOINT", "TO_MEASURE"), "measure": ("MILEPOINT", "MEASURE")},
    "ncdot": {"roadway": ("RouteID", "ROUTE_ID", "ROUTEID"), "bmp": ("FromMeasure", "FROM_MEASURE"), "emp": ("ToMeasure", "TO_MEASURE"), "measure": ("MEASURE",)},
    "generic": {
        "roadway": ("RTE_ID", "ROUTE", "ROUTE_ID", "LRS_ID", "NLFID"), "bmp": ("BEG_MP", "FROM_MP", "BMP", "BEGIN_MP"),
        "emp": ("END_MP", "TO_MP", "EMP"), "measure": ("MEAS", "MEASURE", "MP"),
    },
}
DEFAULT_TOLERANCE = 1e-4


def find_column(columns: list[str], aliases: Iterable[str], wanted: str | None = None) -> str | None:
    """``wanted`` if it exists, else the first alias that does: by exact name
    first, then without regard to case."""
    if wanted in columns:
        return wanted
    folded = {c.lower(): c for c in reversed(columns)}
    aliases = list(aliases)
    return next((a for a in aliases if a in columns), None) or next((folded[a.lower()] for a in aliases if a.lower() in folded), None)


def resolve_roles(columns: list[str], wanted: dict[str, str | None] | None = None, aliases: dict[str, tuple[str, ...]] = ALIASES, require: tuple[str, ...] = ()) -> dict[str, str | None]:
    """Role -> column; a required role without a column raises KeyError."""
    wanted = wanted or {}
    found = {role: find_column(columns, names, wanted.get(role)) for role, names in aliases.items()}
    if lacking := [r for r in require if not found.get(r)]:
        raise KeyError(f"no column for {', '.join(lacking)} among {', '.join(columns)}")
    return found


def pick_profile(columns: list[str], profile: str) -> dict[str, str | None]:
    """Role -> column by an agency's layout, else by the general aliases."""
    general = resolve_roles(columns)
    return {role: find_column(columns, names) or general.get(role) for role, names in PROFILES[profile].items()}


@dataclass(frozen=True)
class LrsSchema:
    """Column names of an event table, the tolerance of contiguity and gaps,
    and the padding of route ids."""

    roadway: str = "ROADWAY"
    bmp: str = "BEGIN_POST"
    emp: str = "END_POST"
    measure: str | None = None
    tolerance: float = DEFAULT_TOLERANCE
    pad: PadRule = PadRule()

    @classmethod
    def of(cls, df: DataFrame, require_line: bool = False, require_measure: bool = False, aliases: dict[str, tuple[str, ...]] = ALIASES, tolerance: float = DEFAULT_TOLERANCE, pad: PadRule = PadRule(), **wanted: str | None) -> LrsSchema:
        need = ("roadway", "bmp", "emp") if require_line else ()
        need += ("roadway", "measure") if require_measure else ()
        found = resolve_roles(df.columns, wanted, aliases, need)
        given = {r: found.get(r) or d for r, d in (("roadway", cls.roadway), ("bmp", cls.bmp), ("emp", cls.emp))}
        return cls(**given, measure=found.get("measure"), tolerance=tolerance, pad=pad)

    def updated(self, **changes) -> LrsSchema:
        return replace(self, **changes)

    def check_line(self, df: DataFrame) -> None:
        self._check(df, self.roadway, self.bmp, self.emp)

    def check_point(self, df: DataFrame) -> None:
        if self.measure is None:
            raise KeyError("the table has no measure column")
        self._check(df, self.roadway, self.measure)

    def _check(self, df: DataFrame, *names: str) -> None:
        if lacking := [n for n in names if n not in df.columns]:
            raise KeyError(f"the table lacks {', '.join(lacking)}")

    # columns of a table of this schema
    @property
    def key(self) -> Column:
        return pad_route_id(col(self.roadway), self.pad)

    @property
    def begin(self) -> Column:
        return to_number(col(self.bmp))

    @property
    def end(self) -> Column:
        return to_number(col(self.emp))

    @property
    def at(self) -> Column:
        return to_number(col(self.measure))

    def attributes(self, df: DataFrame) -> list[str]:
        """All columns but the bounds and geometry."""
        return [c for c in df.columns if c not in (self.bmp, self.emp, "geometry")]


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def advanced_fields(columns: list[str]) -> dict[str, str | None]:
    """Offset, side and effective-date columns."""
    return {r: find_column(columns, ALIASES[r]) for r in ("offset", "side", "from_date", "to_date")}


def preview_columns(df: DataFrame, preferred: Iterable[str] = (), others: int = 6) -> DataFrame:
    """Preferred columns first, then ``others`` more, then geometry."""
    first = [c for c in preferred if c in df.columns]
    rest = [c for c in df.columns if c not in first and c != "geometry"][:others]
    return df.select(*[col(c) for c in [*first, *rest, *(["geometry"] if "geometry" in df.columns else [])]])


def apply_route_pad(df: DataFrame, roadway: str, pad: PadRule = PadRule()) -> DataFrame:
    """Route ids rewritten as they are compared; missing ones stay."""
    return df.withColumn(roadway, F.coalesce(pad_route_id(col(roadway), pad), col(roadway).cast("string")))


def as_of(df: DataFrame, date: str, from_col: str | None = None, to_col: str | None = None) -> DataFrame:
    """Rows in effect at ``date``: from <= date < to, a missing bound is open.

    Without either column, or with an unreadable date, all rows stay.
    """
    day = parse_date(F.lit(date))
    kept = F.lit(True)
    if from_col in df.columns:
        kept &= parse_date(col(from_col)).isNull() | (parse_date(col(from_col)) <= day)
    if to_col in df.columns:
        kept &= parse_date(col(to_col)).isNull() | (parse_date(col(to_col)) > day)
    return df.where(day.isNull() | kept)


def dates_overlap(a_from: Column | None, a_to: Column | None, b_from: Column | None, b_to: Column | None) -> Column:
    """Half-open periods meet; always true where a from-column is not mapped."""
    if a_from is None or b_from is None:
        return F.lit(True)
    low, high = F.lit("0001-01-01").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")
    start = lambda c: F.coalesce(parse_date(c), low)
    stop = lambda c: high if c is None else F.coalesce(parse_date(c), high)
    return (start(a_from) < stop(b_to)) & (start(b_from) < stop(a_to))
