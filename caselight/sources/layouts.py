"""Record layouts of the 41 fixed-width extracts.

A layout is data: a table name, a file name and the fields in record order.
Every record is contiguous, so a field is given by its width alone and its
position follows from the fields before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    start: int  # 1-based byte position
    width: int
    numeric: bool

    @property
    def end(self) -> int:
        return self.start + self.width - 1

    @property
    def spark_type(self) -> T.DataType:
        return T.LongType() if self.numeric else T.StringType()


@dataclass(frozen=True)
class Layout:
    table: str
    file: str
    fields: tuple[Field, ...]

    @property
    def record_bytes(self) -> int:
        return self.fields[-1].end

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type) for f in self.fields])


def make_layout(table: str, file: str, fields: str) -> Layout:
    """Build a layout from ``"name:width name:width# ..."``; ``#`` marks a number."""
    out, start = [], 1
    for item in fields.split():
        name, width = item.split(":")
        numeric = width.endswith("#")
        size = int(width.rstrip("#"))
        out.append(Field(name, start, size, numeric))
        start += size
    return Layout(table, file, tuple(out))


# Table, file, then field:width in record order (# = number).
_EXTRACTS = """
main.demo | demo.txt | UMCReportId:11# AgeGroup:1 Gender:1 DateDatabase:8 Type:1 Region:1 FirstDateDatabase:8
main.drug | DRUG.txt | UMCReportId:11# Drug_Id:11# MedicinalProd_Id:11# DrecNo:6 Seq1:2 Seq2:3 Route:2 Basis:1 Amount:5 AmountU:2 Frequency:2 FrequencyU:3
main.adr | ADR.txt | UMCReportId:11# Adr_Id:11# MedDRA_Id:8# Outcome:1
main.OUT | OUT.txt | UMCReportId:11# Seriousness:2 Serious:1
main.SRCE | SRCE.txt | UMCReportId:11# Type:2
main.LINK | LINK.txt | Drug_Id:11# Adr_Id:11# Dechallenge1:1 Dechallenge2:1 Rechallenge1:1 Rechallenge2:1 TimeToOnsetMin:11 TimeToOnsetMax:11
main.ind | IND.txt | Drug_Id:11# Indication:255
main.followup | FOLLOWUP.txt | UMCReportId:11# ReplacedUMCReportId:11#
sub.AgeGroup_Lx | agegroup_lx.txt | Code:1 Text:25
sub.Gender_Lx | Gender_Lx.txt | Code:1 Text:256
sub.Reporttype_Lx | ReportType_Lx.txt | Code:1 Text:256
sub.Region_Lx | Region_Lx.txt | Code:1 Text:50
sub.RouteOfAdmr_Lx | RouteOfAdm_Lx.txt | Code:2 Text:80
sub.RepBasis_Lx | RepBasis_Lx.txt | Code:1 Text:50
sub.SizeUnit_Lx | SizeUnit_Lx.txt | code:2 Text:80
sub.Frequency_Lx | Frequency_Lx.txt | Code:3 Text:256
sub.Outcome_Lx | Outcome_Lx.txt | Code:1 Text:256
sub.Seriousness_Lx | Seriousness_Lx.txt | Code:2 Text:256
sub.Notifier_Lx | Notifier_Lx.txt | Code:2 Text:256
sub.Dechallenge_Lx | Dechallenge_Lx.txt | Code:1 Text:256
sub.Dechallenge2_Lx | Dechallenge2_Lx.txt | Code:1 Text:256
sub.Rechallenge_Lx | Rechallenge_Lx.txt | Code:1 Text:80
sub.Rechallenge2_Lx | Rechallenge2_Lx.txt | Code:1 Text:80
sub.MedDRAversion | MedDRAversion.txt | MedDRAVersion:10
sub.Suspectedduplicates | SUSPECTEDDUPLICATES.txt | UMC_ReportId:11 Suspected_duplicate_ReportId:11
sub.UscDersafetyReportID | USCDERSAFETYREPORTID.txt | UMC_ReportId:11 Suspected_duplicate_ReportId:100
who.mp | MP.txt | Medicinalprod_Id:10 MedID:35 Drug_record_number:6 Sequence_number_1:2 Sequence_number_2:3 Sequence_number_3:10 Sequence_number_4:10 Generic:1 Drug_name:1500 Name_specifier:30 Marketing_Authorization_Number:30 Marketing_Authorization_date:8 Marketing_Authorization_With:8 Country:10 Company:10 Marketing_Authorization_Holder:10 reference_code:10 source_country:10 Year_of_reference:3 product_type:10 product_group:10 create_date:8 date_changed:8
who.PP | PP.txt | Pharmproduct_Id:10 Pharmaceutical_form:10 Route_of_administration:10 Medicinalprod_Id:10 Number_of_ingredients:2 create_date:8
who.ThG | ThG.txt | Therapgroup_Id:10 ATC_code:10 Create_date:8 Official_ATC_code:1 Medicinalprod_Id:10
who.ING | ING.txt | Ingredient_Id:10 Create_date:8 Substance_Id:10 Quantity:15 Quantity_2:15 Unit:10 Pharmproduct_Id:10 Medicinalprod_Id:10
who.SRCE | SRCE.txt | Reference_code:10 Reference:80 Country_code:10
who.Organization | ORG.txt | Organization_Id:10 Name:80 Country_code:10
who.Country | CCODE.txt | Country_code:10 Country_name:80
who.atc | ATC.txt | ATC_code:10 Level:1 Text:110
who.substance | SUN.txt | Substance_Id:10 CAS_number:10 Language_code:10 Substance_name:250 Year_of_Reference:3 Reference_code:10
who.Pharmaceutical_Form | PF.txt | Pharmform_Id:10 Text:80
who.Strength | STR.txt | Strength_Id:10 Text:500
who.PRG | PRG.txt | Productgroup_Id:10 Productgroup_name:60 Date_recorded:8#
who.UnitX | Unit-X.txt | unit_id:10 Text:40
who.unit | UNIT.txt | Unit_Id:10 Text:40
who.UnitL | Unit-L.txt | unit_id:10 Text:100
"""

LAYOUTS: dict[str, Layout] = {
    layout.table: layout
    for layout in (
        make_layout(*(part.strip() for part in line.split("|")))
        for line in _EXTRACTS.strip().splitlines()
    )
}
