"""Fixtures F-rest and F-entropy, rest profile invariants."""
import datetime as dt
import math

import pytest

from leverkit.operators import rest

D = dt.date.fromisoformat
F_REST = [("2023-09-30", 90, 3), ("2024-04-01", 100, 3), ("2024-04-02", 101, 0),
          ("2024-04-03", 102, -1), ("2024-04-04", 103, -1), ("2024-04-08", 104, 3),
          ("2024-04-08", 105, -1)]


def _outings(spark):
    rows = [(D(d), g, 7, D(d).year) for d, g, _ in F_REST]
    return spark.createDataFrame(rows, "game_date date, game_pk long, pitcher long, game_year int")


def test_days_of_rest_fixture(spark):
    out = rest.days_of_rest(_outings(spark), "pitcher", "game_year", "game_date", "game_pk")
    got = {r.game_pk: r.days_of_rest for r in out.collect()}
    assert got == {g: e for _, g, e in F_REST}


def test_days_of_rest_independent_of_input_order(spark):
    df = _outings(spark).repartition(5).orderBy("game_pk", ascending=False)
    out = rest.days_of_rest(df, "pitcher", "game_year", "game_date", "game_pk")
    assert {r.game_pk: r.days_of_rest for r in out.collect()} == {g: e for _, g, e in F_REST}


def test_unify_outings_semi_join_and_union(spark):
    a = spark.createDataFrame([(D("2024-04-01"), 1, 7, 2024)],
                              "game_date date, game_pk long, pitcher long, game_year int")
    b = spark.createDataFrame([(D("2024-04-02"), 50, 7, 2024), (D("2024-04-02"), 50, 7, 2024),
                               (D("2024-04-03"), 51, 8, 2024)],
                              "game_date date, game_pk long, pid long, game_year int")
    u = rest.unify_outings(a, b, "pitcher", secondary_entity="pid")
    assert sorted(r.game_pk for r in u.collect()) == [1, 50]


def test_entropy_fixture(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, None)],
                               "e int, lab string")
    out = {r.e: r.entropy for r in rest.shannon_entropy(df, "e", "lab").collect()}
    assert math.isclose(out[1], 1.0397207708, rel_tol=1e-9)
    assert out[2] == 0.0
    assert 3 not in out


def test_rest_profile_shares_and_bounds(spark):
    rows = []
    for i, day in enumerate([1, 2, 3, 4, 6, 9, 20, 21]):
        rows.append((dt.date(2024, 5, day), i, 7, 2024))
    df = spark.createDataFrame(rows, "game_date date, game_pk long, pitcher long, game_year int")
    r = rest.days_of_rest(df, "pitcher", "game_year", "game_date", "game_pk")
    p = rest.rest_profile(r, "pitcher", "game_year", "game_date").first()
    # first date dropped, 10-day gap kept: B2B, B2B2B x2, OneDay, TwoDay, TenDay, B2B
    assert p.total == 7
    assert p.B2B == 2 and p.B2B2B == 2 and p.OneDay == 1 and p.TwoDay == 1 and p.TenDay == 1
    shares = [getattr(p, f"{c}_prop") for c in rest.REST_LABELS]
    assert math.isclose(sum(shares), 1.0)
    assert 0 <= p.entropy <= math.log(12)


def test_career_weighted(spark):
    s = spark.createDataFrame([(1, 0.5, 10), (1, 1.0, 30), (2, None, 5)],
                              "p int, m double, n long")
    e = spark.createDataFrame([(1, 2.0)], "p int, entropy double")
    out = {r.p: r for r in rest.career_weighted_metric(s, "p", ["m"], "n", e,
                                                       product_of="m").collect()}
    assert math.isclose(out[1].m, 0.875) and out[1].n == 40
    assert math.isclose(out[1].metric_entropy, 1.75)
    assert out[2].m is None


if __name__ == "__main__":  # pragma: no cover
    pytest.main([__file__])


def test_rest_bucket_performance_and_slices(spark):
    days = [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 14, 15, 16, 18, 19, 20, 22]
    rest_rows, app_rows = [], []
    for i, day in enumerate(days):
        rest_rows.append((7, 100 + i, 2024, dt.date(2024, 6, day)))
        for inning in (7, 8):
            app_rows.append((7, 100 + i, inning, 1.0, 0.0 if inning == 7 else 1.0, 0.5, 3))
    outs = spark.createDataFrame(rest_rows, "pitcher long, game_pk long, game_year int, game_date date")
    r = rest.days_of_rest(outs, "pitcher", "game_year", "game_date", "game_pk")
    apps = spark.createDataFrame(app_rows, "pitcher long, game_pk long, inning int, runs_bs double, "
                                           "runs_allowed double, exp_runs_allowed double, outs_made int")
    perf = rest.rest_bucket_performance(apps, r, "pitcher", "game_pk", "game_year", "game_date",
                                        "runs_bs", "runs_allowed", "exp_runs_allowed", "outs_made",
                                        min_total=15)
    got = {x.days_of_rest: x for x in perf.collect()}
    assert sum(x.appearances for x in got.values()) == 2 * (len(days) - 1)
    # centred values sum to zero over all kept appearances
    assert math.isclose(sum(x.rapo * x.outs_made / 3 for x in got.values()), 0.0, abs_tol=1e-9)
    sl = rest.rest_bucket_slices(perf)
    assert set(sl) == {"b2b2b", "b2b", "one_to_three"}
    assert all(x.days_of_rest < 0 for x in sl["b2b2b"].collect())
    too_few = rest.rest_bucket_performance(apps, r, "pitcher", "game_pk", "game_year", "game_date",
                                           "runs_bs", "runs_allowed", "exp_runs_allowed",
                                           "outs_made", min_total=100)
    assert too_few.count() == 0


def test_double_header_flag(spark):
    out = rest.days_of_rest(_outings(spark), "pitcher", "game_year", "game_date", "game_pk",
                            flag_double_header=True)
    got = {r.game_pk: (r.days_of_rest, r.double_header) for r in out.collect()}
    assert got[105] == (-1, True) and got[103] == (-1, False) and got[90][1] is None
