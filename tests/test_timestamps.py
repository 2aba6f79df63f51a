from datetime import datetime, timedelta

import pytest

from granthika.operators.timestamps import InstantDictionary, normalise, parse_instant, resolve_only

HOME, NY, LONDON = ("Asia/Kolkata", "dmy"), ("America/New_York", "mdy"), ("Europe/London", "dmy")
CASES = [
    ("Posted On: 31 DEC 2023 2:04PM by PIB Somewhere", HOME, "2023-12-31T08:34:00"),
    ("06-Aug-23", HOME, "2023-08-05T18:30:00"),
    ("४ फ़रवरी २०२४ १८:२२", HOME, "2024-02-04T12:52:00"),
    ("1704163113", HOME, "2024-01-02T02:38:33"),
    ("1680069089478", HOME, "2023-03-29T05:51:29.478000"),
    ("Mon Jan 01 01:43:52 +0000 2024", HOME, "2024-01-01T01:43:52"),
    ("20231231T125726+0530", HOME, "2023-12-31T07:27:26"),
    ("1/5/2024 3:42 AM", NY, "2024-01-05T08:42:00"),
    ("05.01.2024 15:50", NY, "2024-01-05T20:50:00"),
    ("March 9, 2025 2:39 AM EST", NY, "2025-03-09T07:39:00"),
    ("2025-03-09 02:17:26", NY, None),
    ("2025-11-02 01:30:00", NY, None),
    ("November 2, 2025 1:30 AM EDT", NY, "2025-11-02T05:30:00"),
    ("2024-07-01 10:00 BST", LONDON, "2024-07-01T09:00:00"),
    ("2024-07-01 10:00 IST", LONDON, "2024-07-01T04:30:00"),
    ("2024-07-01 10:00 EST", LONDON, None),
    ("January 7, 2024 6:43 AM NPT", ("Asia/Kathmandu", "dmy"), "2024-01-07T00:58:00"),
    (" 2023-12-31T06:30:07.5Z\n", HOME, "2023-12-31T06:30:07.500000"),
    ("29-02-2023", HOME, None), ("31-02-2025 10:00", HOME, None), ("12 March, 4:30 PM", HOME, None), ("7 hours ago", HOME, None), ("Today", HOME, None), ("0000-00-00", HOME, None), ("", HOME, None), ("13:00 PM", HOME, None), (None, HOME, None),
]


@pytest.mark.parametrize(("raw", "of", "expected"), CASES)
def test_parse(raw, of, expected):
    micros = parse_instant(raw, *of)
    assert (None if micros is None else (datetime(1970, 1, 1) + timedelta(microseconds=micros)).isoformat()) == expected


def test_dictionary_grows_and_joins(spark, tmp_path):
    schema = "id long, raw string, zone string, date_order string, micros string"
    rows = [(1, "2024-01-01", *HOME, "x"), (2, "2024-01-01", *HOME, "y"), (3, None, *HOME, None), (4, "TBD", *HOME, None)]
    d = InstantDictionary(spark, f"{tmp_path}/d")
    out = {r.id: r for r in normalise(spark.createDataFrame(rows, schema), d).collect()}
    assert out[1].instant_utc == out[2].instant_utc == "2023-12-31T18:30:00.000000Z"
    assert out[3].instant is None and out[4].instant_utc is None and out[1].micros == "x"
    assert d.read().count() == 2
    d.extend(spark.createDataFrame([*rows, (5, "2024-01-02", *HOME, None)], schema))
    assert d.read().count() == 3
    assert resolve_only(spark.createDataFrame(rows, schema), d).count() == 2


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, raw string, zone string, date_order string")
    assert normalise(empty, InstantDictionary(spark, f"{tmp_path}/d")).count() == 0


def test_found_takes_all_but_the_exact_form(spark, tmp_path):
    from granthika.plans.time_queries import p2_found, p2_in_two_loads

    exact, ends = "2024-01-05T10:20:30Z", ["\n", "\r\n", "\r", "\u0085", "\u2028", " ", "\n\n"]
    raws = [exact, "2024-01-05T10:20:30.5Z", *[exact + e for e in ends], "\n" + exact, "2024-01-05T10:20:30.5Z\n", None]
    spark.createDataFrame(list(enumerate(raws)), "id long, published_at string").write.parquet(f"{tmp_path}/pib_releases.parquet")
    spark.createDataFrame([("h.example", "Asia/Kolkata", "dmy")], "organization string, time_zone string, date_order string").write.parquet(f"{tmp_path}/site_profiles.parquet")
    web = [(i, (r, r), ("https://h.example/a",)) for i, r in enumerate(raws)]
    spark.createDataFrame(web, "record_no long, dates struct<published_at:string,retrieved_at:string>, source struct<source_url:string>").write.parquet(f"{tmp_path}/webscraper_output.parquet")
    found = {(r.field_name, r.row_no): r.instant_utc for r in p2_found(spark, str(tmp_path)).collect()}
    cases = {i: f"2024-01-05T10:20:30.{'5' if '.' in r else '0'}00000Z" for i, r in enumerate(raws) if i > 1 and r is not None}
    assert found == {(f, i): t for f in ("published_at", "dates.published_at", "dates.retrieved_at") for i, t in cases.items()}
    assert {(r.field_name, r.row_no): r.instant_utc for r in p2_in_two_loads(spark, str(tmp_path)).collect()} == found
