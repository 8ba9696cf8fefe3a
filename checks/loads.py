"""The 41 extract layouts over the driver tables.

No extract ships, so each query writes a driver table out in the layout's
record format, whole, and reads that file back with the fixed-width scan. The
field texts are plain SQL that both engines take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.sources.fixed_width import CUT, ERROR, read_fixed_width
from caselight.sources.layouts import LAYOUTS, Layout
from caselight.storage import scratch_path

_LINES = 500_000  # records a file

# (driver table, whole-number fields, text fields)
_SOURCES = {
    "lineitem": (
        ("l_orderkey", "l_partkey", "l_suppkey"),
        (
            "l_returnflag",
            "l_linestatus",
            "concat(l_returnflag, l_linestatus, cast(l_linenumber as string), ' of ', cast(l_orderkey as string))",
            "cast(l_linenumber as string)",
            "replace(substr(cast(l_shipdate as string), 1, 10), '-', '')",
        ),
    ),
    "orders": (
        ("o_orderkey", "o_custkey"),
        (
            "o_orderstatus",
            "o_orderpriority",
            "replace(substr(cast(o_orderdate as string), 1, 10), '-', '')",
            "substr(o_orderpriority, 3, 20)",
            "cast(o_custkey as string)",
        ),
    ),
    "customer": (
        ("c_custkey", "c_nationkey"),
        ("cast(c_custkey as string)", "concat(c_name, ' in ', c_mktsegment)", "c_mktsegment"),
    ),
    "part": (
        ("p_partkey", "p_size"),
        (
            "cast(p_partkey as string)",
            "p_name",
            "p_brand",
            "p_type",
            "cast(p_size as string)",
            "concat(p_name, ' by ', p_brand)",
        ),
    ),
    "supplier": (
        ("s_suppkey", "s_nationkey"),
        ("cast(s_suppkey as string)", "s_name", "cast(s_nationkey as string)"),
    ),
}


def source_of(layout: Layout) -> str:
    library, name = layout.table.split(".")
    if library == "main":
        return "lineitem" if name in ("drug", "adr", "LINK", "ind") else "orders"
    if library == "sub":
        return "customer"
    return "supplier" if name in ("Organization", "Country", "SRCE") else "part"


def field_texts(layout: Layout) -> list[tuple[str, str]]:
    """(field name, SQL for its text or number) in record order."""
    numbers, texts = _SOURCES[source_of(layout)]
    out, seen_numbers, seen_texts = [], 0, 0
    for f in layout.fields:
        if f.numeric:
            out.append((f.name, numbers[seen_numbers % len(numbers)]))
            seen_numbers += 1
        else:
            out.append((f.name, f"substr({texts[seen_texts % len(texts)]}, 1, {f.width})"))
            seen_texts += 1
    return out


def record_sql(layout: Layout, spoil: str | None = None) -> str:
    """SQL for one full record; ``spoil`` is a condition under which the first
    field is not a number."""
    parts = []
    for f, (_, text) in zip(layout.fields, field_texts(layout)):
        if f.numeric:
            number = f"cast({text} as string)"
            if spoil and f is layout.fields[0]:
                number = f"if({spoil}, concat({number}, 'x'), {number})"
            parts.append(f"lpad({number}, {f.width}, ' ')")
        else:
            parts.append(f"rpad({text}, {f.width}, ' ')")
    return f"concat({', '.join(parts)})"


def write_lines(lines: DataFrame, path: str) -> None:
    """Records as compressed text, as most of one is padding; in files that are
    small enough to be read side by side, as such a file cannot be split."""
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", _LINES).text(path)


def write_records(spark: SparkSession, sf_dir: str, layout: Layout, record: str) -> str:
    path = scratch_path(spark, "extract")
    table = spark.read.parquet(f"{sf_dir}/{source_of(layout)}.parquet")
    write_lines(table.select(F.expr(record).alias("value")), path)
    return path


def _load(layout: Layout):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = write_records(spark, sf_dir, layout, record_sql(layout))
        return read_fixed_width(spark, path, layout).drop(ERROR, CUT)

    return run


def query_name(layout: Layout) -> str:
    return "load_" + layout.table.replace(".", "_").lower()


def queries() -> dict:
    return {query_name(layout): _load(layout) for layout in LAYOUTS.values()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for layout in LAYOUTS.values():
        columns = []
        for f, (name, text) in zip(layout.fields, field_texts(layout)):
            if f.numeric:
                columns.append(f'cast({text} as bigint) as "{name}"')
            else:
                columns.append(f"nullif(trim({text}), '') as \"{name}\"")
        out[query_name(layout)] = f"select {', '.join(columns)} from {source_of(layout)}"
    return out
