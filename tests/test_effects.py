"""The additive fit against a plain one, rules from it, and merging."""

import random

import pytest

from tidemark.operators import effects


def plain_fit(rows):
    """rows: (tier, group, provider, kbps, samples); tables of effects after at most twenty rounds."""
    mean = lambda pairs: sum(v * w for v, w in pairs) / sum(w for _, w in pairs)
    grand = mean([(r[3], r[4]) for r in rows])
    tables = [{r[f]: 0.0 for r in rows} for f in range(3)]
    for _ in range(20):
        moved = 0.0
        for f in range(3):
            for k in tables[f]:
                mine = [r for r in rows if r[f] == k]
                new = mean([(r[3] - grand - sum(tables[o][r[o]] for o in range(3) if o != f), r[4]) for r in mine])
                moved = max(moved, abs(new - tables[f][k]))
                tables[f][k] = new
            centre = mean([(v, sum(r[4] for r in rows if r[f] == k)) for k, v in tables[f].items()])
            tables[f] = {k: v - centre for k, v in tables[f].items()}
        if moved < 1:
            break
    return grand, tables


@pytest.mark.parametrize("most_cells", [effects.MOST_CELLS, 0])
def test_fit(spark, most_cells):
    rng = random.Random(5)
    rows = [(t, g, p, 3000 + 900 * i + (1500 if g == "g1" else 0) + 100 * j + rng.randrange(300), rng.randrange(1, 60))
            for i, t in enumerate(["sd", "hd", "fhd"]) for g in ["g1", "g2", "g3", ""] for j, p in enumerate(["p1", "p2"]) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "tier string, group_name string, provider_name string, effective_kbps bigint, samples bigint")
    grand, tables = plain_fit(rows)
    got = {(r.factor, r.key): r for r in effects.fitted(df, most_cells=most_cells).collect()}
    assert len(got) == sum(map(len, tables))
    for f, table in zip(effects.FACTORS, tables, strict=True):
        for k, v in table.items():
            assert abs(got[f, k].delta_kbps - v) <= 0.5 + 1e-6 and abs(got[f, k].baseline_kbps - grand) <= 0.5


def test_fit_of_nothing(spark):
    df = spark.createDataFrame([], "tier string, group_name string, provider_name string, effective_kbps bigint, samples bigint")
    assert effects.fitted(df).count() == 0


def test_rules(spark):
    rows = [("tier", "fhd", 30, 0, 1300, 0), ("tier", "unknown", 90, 0, 5000, 0), ("provider_name", "a", 19, 0, 5000, 0), ("group_name", " ", 50, 0, 5000, 0),
            ("group_name", "g", 50, 0, -9000, 0), ("provider_name", "b", 50, 0, 40, 0)]
    df = spark.createDataFrame(rows, "factor string, key string, samples bigint, effective_kbps bigint, delta_kbps bigint, baseline_kbps bigint")
    got = {(r.type, r.value, r.points) for r in effects.rules(df, {"fhd": "F"}).collect()}
    assert got == {("regex", "F", 7), ("group", "g", -15)}
