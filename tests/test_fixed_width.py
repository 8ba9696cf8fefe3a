import pytest
from pyspark.sql import functions as F

from caselight.plans.loading import load_extracts
from caselight.sources.fixed_width import CUT, ERROR, load_report, parse_fixed_width, read_fixed_width
from caselight.sources.layouts import LAYOUTS, make_layout
from caselight.sources.tables import read_saved

SMALL = make_layout("t", "t.txt", "id:4# code:1 text:5")


def parsed(spark, lines, layout=SMALL, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    return [r.asDict() for r in parse_fixed_width(df, layout, **options).collect()]


def test_layout_inventory():
    assert len(LAYOUTS) == 41
    assert sum(len(v.fields) for v in LAYOUTS.values()) == 147
    # Record bytes of every extract.
    sizes = {
        "main.demo": 31, "main.drug": 59, "main.adr": 31, "main.OUT": 14, "main.SRCE": 13,
        "main.LINK": 48, "main.ind": 266, "main.followup": 22, "sub.AgeGroup_Lx": 26,
        "sub.Gender_Lx": 257, "sub.Reporttype_Lx": 257, "sub.Region_Lx": 51,
        "sub.RouteOfAdmr_Lx": 82, "sub.RepBasis_Lx": 51, "sub.SizeUnit_Lx": 82,
        "sub.Frequency_Lx": 259, "sub.Outcome_Lx": 257, "sub.Seriousness_Lx": 258,
        "sub.Notifier_Lx": 258, "sub.Dechallenge_Lx": 257, "sub.Dechallenge2_Lx": 257,
        "sub.Rechallenge_Lx": 81, "sub.Rechallenge2_Lx": 81, "sub.MedDRAversion": 10,
        "sub.Suspectedduplicates": 22, "sub.UscDersafetyReportID": 111, "who.mp": 1742,
        "who.PP": 50, "who.ThG": 39, "who.ING": 88, "who.SRCE": 100, "who.Organization": 100,
        "who.Country": 90, "who.atc": 121, "who.substance": 293, "who.Pharmaceutical_Form": 90,
        "who.Strength": 510, "who.PRG": 78, "who.UnitX": 50, "who.unit": 50, "who.UnitL": 110,
    }
    assert {k: v.record_bytes for k, v in LAYOUTS.items()} == sizes


def test_positions_follow_widths():
    mp = {f.name: (f.start, f.end) for f in LAYOUTS["who.mp"].fields}
    assert mp["Drug_name"] == (78, 1577)
    assert mp["date_changed"] == (1735, 1742)


@pytest.mark.parametrize(
    "field, value, error",
    [("    ", None, False), ("   .", None, False), ("  12", 12, False), ("12  ", 12, False),
     ("1 2 ", None, True), ("12a ", None, True), ("9999", 9999, False)],
)
def test_numbers(spark, field, value, error):
    (row,) = parsed(spark, [field + "xhello"])
    assert row["id"] == value
    assert row[ERROR] is error
    assert row["text"] == "hello"


def test_eleven_digits(spark):
    (row,) = parsed(spark, ["99999999999"], make_layout("t", "t", "id:11#"))
    assert row["id"] == 99999999999


def test_text_blanks_and_dots(spark):
    rows = parsed(spark, ["   1x  ab ", "   1.  .  ", "   1     .", "   1 a.b  "])
    assert [(r["code"], r["text"]) for r in rows] == [
        ("x", "ab"), (None, None), (None, None), (None, "a.b"),
    ]


def test_short_records(spark):
    lines = ["   1xab", "   1x", "   1", "  1", ""]
    missing = parsed(spark, lines)
    assert [r["text"] for r in missing] == [None] * 5
    assert [r["code"] for r in missing] == ["x", "x", None, None, None]
    assert [r["id"] for r in missing] == [1, 1, 1, None, None]
    assert [r[CUT] for r in missing] == [1, 0, 0, 1, 0]
    kept = parsed(spark, lines, short_field="truncate")
    assert [r["text"] for r in kept] == ["ab", None, None, None, None]
    assert [r["id"] for r in kept] == [1, 1, 1, 1, None]
    assert not any(r[ERROR] for r in missing + kept)


def test_bytes_not_letters(spark):
    layout = make_layout("t", "t", "a:3 b:2")
    (row,) = parsed(spark, ["éxab"], layout)  # é takes two bytes
    assert (row["a"], row["b"]) == ("éx", "ab")
    (cut,) = parsed(spark, ["xxéab"], layout)  # and may be cut in two
    assert cut["a"] == "xx�"


def test_latin1_file(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"\xe9x\xe8ab\n   ab\r\n")
    layout = make_layout("t", "t.txt", "a:3 b:2")
    rows = read_fixed_width(spark, str(tmp_path / "t.txt"), layout, charset="ISO-8859-1").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("éxè", "ab"), (None, "ab")]


def test_null_record_and_bad_option(spark):
    (row,) = parsed(spark, [None])
    assert row["id"] is None and row[ERROR] is False and row[CUT] == 0
    with pytest.raises(ValueError):
        parsed(spark, ["x"], short_field="guess")


def test_every_layout_reads_its_own_records(spark):
    for layout in LAYOUTS.values():
        line = "".join(
            str(i % 10).rjust(f.width) if f.numeric else chr(97 + i % 26).ljust(f.width)
            for i, f in enumerate(layout.fields)
        )
        (row,) = parsed(spark, [line], layout)
        for i, f in enumerate(layout.fields):
            assert row[f.name] == (i % 10 if f.numeric else chr(97 + i % 26))


def test_load_report_counts(spark):
    df = spark.createDataFrame([("   1xhello",), ("bad xhello",), ("   1xhe",)], "value string")
    row = load_report(parse_fixed_width(df, SMALL), "t").first()
    assert (row["records"], row["error_records"], row["cut_fields"]) == (3, 1, 1)


def test_load_extracts(spark, tmp_path):
    for name in ("main", "who"):
        (tmp_path / name).mkdir()
    (tmp_path / "main" / "SRCE.txt").write_text("          1ab\n         xxcd\n")
    (tmp_path / "who" / "SRCE.txt").write_text("r1".ljust(10) + "book".ljust(80) + "KR".ljust(10))
    report = load_extracts(
        spark, {k: str(tmp_path / k) for k in ("main", "who")}, str(tmp_path / "out"),
        [LAYOUTS["main.SRCE"], LAYOUTS["who.SRCE"]],
    )
    counts = {r["table"]: (r["records"], r["error_records"]) for r in report.collect()}
    assert counts == {"main.SRCE": (2, 1), "who.SRCE": (1, 0)}
    main = read_saved(spark, str(tmp_path / "out"), "main.SRCE")
    assert main.columns == ["UMCReportId", "Type"]
    assert sorted(r["Type"] for r in main.collect()) == ["ab", "cd"]
    assert read_saved(spark, str(tmp_path / "out"), "who.SRCE").first()["Reference"] == "book"


def test_parsing_needs_no_shuffle(spark):
    df = spark.range(10).select(F.lit("   1xhello").alias("value"))
    plan = parse_fixed_width(df, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_extracts_are_written_compressed_in_small_files(spark, tmp_path, monkeypatch):
    from checks import loads

    monkeypatch.setattr(loads, "_LINES", 300)
    layout = make_layout("check.padded", "padded.txt", "key:11# note:200")
    path = str(tmp_path / "padded.txt")
    loads.write_lines(spark.range(1000).coalesce(1).selectExpr("concat(lpad(string(id), 11, ' '), rpad('n', 200, ' ')) as value"), path)
    files = list((tmp_path / "padded.txt").glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 1000 * 211 / 10
    back = read_fixed_width(spark, path, layout)
    assert sorted((r["key"], r["note"]) for r in back.collect()) == [(k, "n") for k in range(1000)]
