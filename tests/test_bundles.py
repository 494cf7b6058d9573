"""Users' reading files in bundles: the id is that of the file named on the line, and files do not grow with users."""

from __spark_entry__ import queries
from loadloom.plans import report_queries
from loadloom.sources import readers

SF = "/root/testdata/sf0.01"


def test_bundle_takes_user_from_the_named_file(spark, tmp_path):
    a, b = "a" * 64, "0123456789abcdef" * 4
    (tmp_path / "part-0.csv").write_text(f"user_file,index,fl,kWh,imp\n{a}.csv,2020-01-01 00:00:00,0,1.5,0\n{b}.csv,2020-01-01 01:00:00,0,NA,0\n")
    (tmp_path / "part-1.csv").write_text(f"user_file,index,fl,kWh,imp\n{b}.csv,2021-06-01 05:00:00,0,-2,0\n")
    rows = readers.read_readings_csv(spark, str(tmp_path), file_glob="*.csv", name_col="user_file").collect()
    assert sorted((r.user_id, r.year, r.month, r.kwh) for r in rows if r.kwh is not None) == [(b, 2021, 6, -2.0), (a, 2020, 1, 1.5)]
    assert len(rows) == 3


def test_ingest_opens_fewer_files_than_there_are_users(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report_queries, "_scratch", lambda spark: str(tmp_path / "trip"))
    got = queries()["readings_csv_ingest"](spark, SF)
    users = got.select("user_id").distinct().count()
    assert users > 100 and len(list((tmp_path / "trip").rglob("*.csv"))) < 10
