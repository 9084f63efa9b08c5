"""Queries that take all of their input."""

from collections import Counter

from matloom import queries as engine
from matloom.operators import kmeans

FOLDER = "/root/testdata/sf0.001"


def test_fk_statistic_runs_until_it_stops_by_itself(spark):
    got = [tuple(r) for r in engine.queries()["fk_statistic"](spark, FOLDER).collect()]
    results = kmeans.kmeans_batch(engine.matrix_e(spark, FOLDER), [1, 2, 3, 4])
    assert max(r.iterations for r in results) > 5
    assert got == [tuple(r) for r in kmeans.results_table(spark, results, 64).collect()]


def test_coverage_of_all_bins_by_brute_force(spark):
    refs = {r["ref"]: r["start_bin"] for r in engine.bins_g(spark, FOLDER).collect()}
    covered, bins = Counter(), set()
    for r in engine.points_g(spark, FOLDER).collect():
        for x in range(max(r["start"], 0), min(r["end"], engine.MONTH)):
            bin_ = refs[r["ref"]] + x // engine.BIN
            bins.add(bin_)
            covered[bin_, x % engine.BIN] += 1
    got = engine.queries()["per_unit_coverage_all_bins"](spark, FOLDER).persist()
    assert {(r["bin"], r["offset"]): r["count"] for r in got.where("count <> 0").collect()} == covered
    assert got.count() == got.select("bin", "offset").distinct().count() == len(bins) * engine.BIN
    assert {r["bin"] for r in got.select("bin").distinct().collect()} == bins
    got.unpersist()


def test_regions_of_all_events_by_brute_force(spark):
    rows = engine.points_g(spark, FOLDER).collect()
    expected = Counter((p["event_id"], q["event_id"]) for p in rows for q in rows if p["ref"] == q["ref"] and q["start"] <= p["start"] < q["end"])
    got = Counter((r["event_id"], r["region"]) for r in engine.queries()["regions_of_points"](spark, FOLDER).collect())
    assert got == expected and len(expected) >= len(rows)
