"""Fixed-width text -> typed columns.

Positions count bytes, so fields are cut from the binary value and only then
decoded. Everything is one projection over the text scan: no shuffle, and the
splits of a file are parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.sources.layouts import Field, Layout

ERROR = "_error"
CUT = "_cut_fields"
_RAW, _SIZE = "_raw", "_size"


def _text(field: Field, charset: str) -> Column:
    piece = F.substring(F.col(_RAW), field.start, field.width)
    if charset.upper().replace("-", "") == "UTF8":
        # A slice may end inside a multi-byte letter; such bytes become U+FFFD.
        text = F.make_valid_utf8(piece.cast("string"))
    else:
        text = F.decode(piece, charset)
    return F.trim(text)


def parse_fixed_width(
    df: DataFrame,
    layout: Layout,
    short_field: str = "missing",
    charset: str = "UTF-8",
    column: str = "value",
) -> DataFrame:
    """Cut ``column`` into the fields of ``layout``.

    Blank and lone ``.`` give NULL. A number that cannot be read gives NULL and
    sets ``_error``. A field the record ends inside of gives NULL under
    ``short_field="missing"`` and what is left of it under ``"truncate"``;
    either way it counts in ``_cut_fields``.

    The projections are staged - cut, clear blanks, read numbers - so that each
    slice is made once however often its value is looked at.
    """
    if short_field not in ("missing", "truncate"):
        raise ValueError("short_field is 'missing' or 'truncate'")
    raw = df.select(
        F.col(column).cast("binary").alias(_RAW), F.octet_length(column).alias(_SIZE)
    )
    size = F.col(_SIZE)
    cut = raw.select(_SIZE, *[_text(f, charset).alias(f.name) for f in layout.fields])

    def present(field: Field) -> Column:
        text = F.col(field.name)
        there = (text != "") & (text != ".")
        if short_field == "missing":
            there = there & (size >= field.end)
        return F.when(there, text).alias(field.name)

    texts = cut.select(_SIZE, *[present(f) for f in layout.fields])
    numbers = [f for f in layout.fields if f.numeric]
    read = texts.select(
        "*", *[F.col(f.name).try_cast("bigint").alias(f"_n_{f.name}") for f in numbers]
    )
    bad = F.lit(False)
    for f in numbers:
        bad = bad | (F.col(f.name).isNotNull() & F.col(f"_n_{f.name}").isNull())
    wide = [f for f in layout.fields if f.width > 1]
    inside = F.lit(0)
    for f in wide:
        inside = inside + ((size >= f.start) & (size < f.end)).cast("int")
    return read.select(
        *[F.col(f"_n_{f.name}" if f.numeric else f.name).alias(f.name) for f in layout.fields],
        bad.alias(ERROR),
        F.coalesce(inside, F.lit(0)).alias(CUT),
    )


def read_fixed_width(
    spark: SparkSession,
    path: str,
    layout: Layout,
    short_field: str = "missing",
    charset: str = "UTF-8",
) -> DataFrame:
    """Scan a fixed-width extract. There is no header line."""
    return parse_fixed_width(spark.read.text(path), layout, short_field, charset)


def load_report(df: DataFrame, table: str) -> DataFrame:
    """One row for a parsed table: records, records with errors, cut fields."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col(ERROR).cast("long")), F.lit(0)).alias("error_records"),
        F.coalesce(F.sum(F.col(CUT).cast("long")), F.lit(0)).alias("cut_fields"),
    ).select(F.lit(table).alias("table"), "records", "error_records", "cut_fields")
