"""Load every fixed-width extract into typed Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caselight.sources.fixed_width import CUT, ERROR, read_fixed_width
from caselight.sources.layouts import LAYOUTS, Layout
from caselight.sources.tables import write_table


def load_extracts(
    spark: SparkSession,
    folders: Mapping[str, str],
    target: str,
    layouts: Iterable[Layout] = tuple(LAYOUTS.values()),
    short_field: str = "missing",
    charset: str = "UTF-8",
    mode: str = "errorifexists",
    parallelism: int = 4,
) -> DataFrame:
    """Parse and store each table; return records, errors and cut fields per table.

    ``folders`` maps the part of a table name before the dot to the folder its
    file is in. Every file is read once: the counts are observed while the
    table is written. Tables do not depend on each other and are submitted side
    by side.
    """

    def load(layout: Layout) -> tuple[str, int, int, int]:
        path = f"{folders[layout.table.split('.')[0]].rstrip('/')}/{layout.file}"
        seen = Observation()
        rows = read_fixed_width(spark, path, layout, short_field, charset).observe(
            seen,
            F.count(F.lit(1)).alias("records"),
            F.count_if(ERROR).alias("errors"),
            F.sum(F.col(CUT).cast("bigint")).alias("cut"),
        )
        write_table(rows.drop(ERROR, CUT), target, layout.table, mode)
        counts = seen.get
        return layout.table, counts["records"], counts["errors"], counts["cut"] or 0

    with ThreadPool(parallelism) as pool:
        report = pool.map(load, list(layouts))
    return spark.createDataFrame(
        report, "table string, records bigint, error_records bigint, cut_fields bigint"
    )
