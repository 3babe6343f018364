"""Grid records: one JSON object per row, turned into typed columns.

The same projection serves a batch read and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.project import newest_rows
from ..series import SeriesSpec, q

# Field names of a record, and those that count as 0 when the key is absent.
TIME_FIELD = "date_heure"
LOAD_FIELD = "consommation"
NO_DEFAULT = ["consommation", "prevision_j1", "prevision_j", "taux_co2"]
ZERO_IF_ABSENT = [
    "fioul", "charbon", "gaz", "nucleaire", "eolien", "solaire", "hydraulique", "pompage",
    "bioenergies", "ech_physiques", "stockage_batterie", "destockage_batterie",
    "ech_comm_angleterre", "ech_comm_espagne", "ech_comm_italie", "ech_comm_suisse",
    "ech_comm_allemagne_belgique",
]
NUMERIC_FIELDS = NO_DEFAULT + ZERO_IF_ABSENT


TEXT_SCHEMA = ", ".join(f"{n} string" for n in [TIME_FIELD, *NUMERIC_FIELDS])


def parse_records(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Typed rows from JSON text, one object per row of ``column``.

    Rows without a readable time stamp are dropped. An absent key of the generation and
    exchange fields reads 0; an explicit null stays null. ``y`` is the consumption.

    The parsed object is unnested by a generator, below which Spark does not push the
    filter on the time stamp; pushed down, it would parse every line a second time.
    """
    keep = keep or []

    def number(name: str) -> str:
        return f"nullif(try_cast({name} AS double), double('NaN'))"

    keys = F.json_object_keys(column).alias("_keys")
    texts = lines.select(*keep, keys, F.inline(F.array(F.from_json(column, TEXT_SCHEMA))))
    numbers = [f"{number(n)} AS {n}" for n in NO_DEFAULT]
    numbers += [f"CASE WHEN {n} IS NULL AND NOT array_contains(_keys, '{n}') THEN 0D "
                f"ELSE {number(n)} END AS {n}" for n in ZERO_IF_ABSENT]
    stamp = f"try_to_timestamp({TIME_FIELD}) AS {TIME_FIELD}"
    return (texts.selectExpr(*map(q, keep), stamp, *numbers, f"{number(LOAD_FIELD)} AS y")
            .where(F.col(TIME_FIELD).isNotNull()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON-lines files."""
    return parse_records(spark.read.text(path))


def newest(df: DataFrame, spec: SeriesSpec, n: int = 1000, where: Column | None = None) -> DataFrame:
    """The newest ``n`` rows with a target, per series. The filters reach the file scan."""
    rows = df.where(F.col(spec.target).isNotNull())
    return newest_rows(rows if where is None else rows.where(where), spec, n)


def first_non_empty(*tables: DataFrame) -> DataFrame:
    """The first table that has a row; the last one when none has. Failures surface."""
    for table in tables[:-1]:
        if not table.isEmpty():
            return table
    return tables[-1]
