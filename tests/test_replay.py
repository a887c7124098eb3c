"""The recorded run again: case file, names, outcomes and result file."""

from __future__ import annotations

from collections import Counter

import pytest
from labelled_cases import RESULTS
from pyspark.sql import functions as F

from rayline.functions import geo
from rayline.operators.evaluate import evaluated, summary, summary_by
from rayline.sinks import results as sink
from rayline.sources import cases

LINES = RESULTS.splitlines()
ROWS = [line.replace('"', "").split(";") for line in LINES]


@pytest.fixture(scope="module")
def replayed(spark, tmp_path_factory):
    """The cases read from a file of them, with the names that were detected, evaluated anew."""
    path = tmp_path_factory.mktemp("replay") / "cases.csv"
    case = lambda r: ";".join([r[1].replace(",", ", "), r[2].replace(",", ", "), r[3], r[4], "", r[9]])
    path.write_text("\n".join(["header", *map(case, ROWS)]) + "\n", encoding="utf-8")
    names = []
    for r in ROWS:
        main, other = (r[5].split(" / ") + [None])[:2] if r[6] == "FAIL" else (None, r[5]) if r[8] == "YES" else (r[5], None)
        names.append((int(r[0]), main, other))
    known = spark.createDataFrame(names, "row_number int, road_name string, alternative_road_name string").withColumn("error", F.lit(None).cast("string"))
    return evaluated(cases.read_cases(spark, str(path)).join(known, "row_number")).cache()


def test_result_lines(replayed):
    got = [r["value"] for r in sink.result_line(replayed).orderBy("row_number").collect()]
    assert got == LINES


def test_tallies(replayed):
    s = summary(replayed).first()
    assert (s["total"], s["passed"], s["passed_direct"], s["passed_alternative"], s["failed"], s["errors"], s["success_rate"]) == (100, 91, 82, 9, 9, 0, 91.0)
    by = {r["city"]: (r["passed_direct"], r["passed_alternative"], r["failed"]) for r in summary_by(replayed, ["city"]).collect()}
    assert by == {"Athens": (55, 5, 7), "Thessaloniki": (19, 2, 1), "Patra": (7, 2, 1), "Karystos": (1, 0, 0), None: (82, 9, 9)}
    assert Counter(r[9] for r in ROWS) == {"Athens": 67, "Thessaloniki": 22, "Patra": 10, "Karystos": 1}


def test_report(replayed):
    lines = list(sink.report_lines(replayed))
    assert lines[4].startswith("  #001 | PASS            | Target: Theoxari Kotsika          | Got: ") and len(lines) == 4 + 100 + 11
    assert [x.split()[-1] for x in lines[-7:-1]] == ["82/100", "9/100", "91/100", "9/100", "0/100", "91.0%"]


def test_bearings(replayed):
    """Known bearings of three of the cases."""
    cur, prev = F.col("current"), F.col("previous")
    heading = geo.bearing(prev["lat"], prev["lon"], cur["lat"], cur["lon"])
    got = {r["row_number"]: r["b"] for r in replayed.select("row_number", heading.alias("b")).collect()}
    assert [got[i] for i in (1, 2, 69)] == [pytest.approx(x, abs=1e-6) for x in (279.953047, 47.121524, 75.397766)]
