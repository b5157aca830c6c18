"""Hand-computed and planted cases."""

import datetime
import hashlib
import json
import math
import random
import re
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars
from panelwright.functions import windows as win
from panelwright.operators import backtest, balance, baskets, cross_section, factors, lab, options, panel, pit, rules, screen, signals, stats, workbench
from panelwright.plans import QUERIES, desk_plans
from panelwright.sources import readers, sinks
from panelwright.streaming.append import append_stream

D = datetime.date


def test_facts_are_hidden_until_filed(spark):
    rows = [(1, D(2024, 5, 1), 1.10, False, 1), (1, D(2024, 8, 1), 1.05, True, 2)]
    f = spark.createDataFrame(rows, "key long, filed date, value double, is_amendment boolean, t int")
    at = lambda day, **k: [r.value for r in pit.latest(f, ["key"], day, ["t"], **k).collect()]
    assert at("2024-04-30") == []
    assert at("2024-05-01") == [1.10]
    assert at("2024-08-01") == [1.05]
    assert at("2024-12-01", originals="is_amendment") == [1.10]
    assert at("2024-12-01", first=True) == [1.10]
    dates = spark.createDataFrame([(D(2024, 4, 30),), (D(2024, 6, 1),), (D(2024, 9, 1),)], "as_of date")
    assert sorted((r.as_of, r.value) for r in pit.grid(f, ["key"], dates, ["t"]).collect()) == [(D(2024, 6, 1), 1.10), (D(2024, 9, 1), 1.05)]


def test_bounded_as_of_price(spark):
    px = spark.createDataFrame([("a", D(2024, 1, 1), 10.0), ("a", D(2024, 1, 5), 11.0), ("a", D(2024, 1, 6), -1.0)], "ticker string, date date, close double")
    t = spark.createDataFrame([("a", D(2024, 1, 4)), ("a", D(2024, 1, 7)), ("a", D(2024, 1, 20)), ("b", D(2024, 1, 4))], "ticker string, date date")
    got = {(r.ticker, r.date): r.close for r in pit.asof_back(t, px, "ticker", "date", "close", 5).collect()}
    assert got == {("a", D(2024, 1, 4)): 10.0, ("a", D(2024, 1, 7)): 11.0, ("a", D(2024, 1, 20)): None, ("b", D(2024, 1, 4)): None}


def test_forward_as_of(spark):
    t = spark.createDataFrame([(D(2024, 1, 6),), (D(2024, 1, 9),)], "signal_date date")
    cal = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),)], "date date")
    assert {r.signal_date: r.trade_date for r in pit.asof_forward(t, cal, "signal_date").collect()} == {D(2024, 1, 6): D(2024, 1, 8), D(2024, 1, 9): None}


def test_factors_of_the_annual_bundle(spark):
    row = dict(cik=1, fy=2024, revenue=1e9, net_income=1e8, operating_income=1.5e8, depreciation=5e7, interest_expense=1e7, tax_expense=4e7, operating_cash_flow=1.8e8, capex=6e7, total_assets=2e9, stockholders_equity=8e8, long_term_debt=3e8, cash=1e8, shares=5e7, close=20.0)
    a = spark.createDataFrame([row])
    r = factors.quality_factors(factors.value_factors(a)).first()
    assert r.ebitda == 2e8 and r.fcf == 1.2e8 and r.ev == 20 * 5e7 + 2e8
    assert r.roic == pytest.approx(1.5e8 * (1 - 4e7 / 1.4e8) / 1.1e9)
    assert r.accruals == pytest.approx((1e8 - 1.8e8) / 2e9)


def test_sue_by_a_loop(spark):
    """A quarter's surprise against the last eight of the same quarter, by a plain loop; a missing year breaks the chain."""
    rng = np.random.default_rng(6)
    rows = [(k, D(y, q * 3, 28), f"Q{q}", float(rng.normal())) for k in (1, 2) for y in range(2008, 2024) for q in (1, 2, 3) if (k, y, q) != (2, 2015, 2)]
    want = {}
    for k in (1, 2):
        for q in (1, 2, 3):
            series = [(end, eps) for key, end, fp, eps in rows if key == k and fp == f"Q{q}"]
            diffs = [None] + [b[1] - a[1] if b[0].year - a[0].year == 1 else None for a, b in zip(series, series[1:], strict=False)]
            for i, (end, _) in enumerate(series):
                past = [x for x in diffs[max(0, i - 8) : i] if x is not None]
                want[k, end] = diffs[i] / float(np.std(past)) if diffs[i] is not None and len(past) >= 5 else None
    out = {(r.cik, r.period_end): r.sue for r in factors.sue(spark.createDataFrame(rows, "cik int, period_end date, fp string, eps double")).collect()}
    assert out.keys() == want.keys() and all((out[x] is None) == (want[x] is None) and (want[x] is None or out[x] == pytest.approx(want[x])) for x in want)
    assert min(end.year for (k, end), v in want.items() if v is not None) == 2014  # the seventh year


def test_margins_take_eight_years_then_drop(spark):
    rows = [(1, 2000 + i, -1.0 if i in (9, 8) else 100.0, float(10 + i)) for i in range(10)]
    got = factors.margin_stability(spark.createDataFrame(rows, "cik int, fy int, revenue double, operating_income double"), ["cik"]).first()
    assert got.n_margins == 6 and got.margin_stability == pytest.approx(1 / np.std([(10 + i) / 100 for i in range(2, 8)]))


def test_running_product_with_zero_and_negative_factors(spark):
    for factors_, want in (([1.5, 0.0, 2.0], [1.5, 0, 0]), ([2.0, -0.5, -3.0, None], [2, -1, 3, 3]), ([None, 4.0], [1, 4])):
        df = spark.createDataFrame([("a", i, x) for i, x in enumerate(factors_)], "k string, i int, x double")
        assert [r[0] for r in df.select("i", win.running_product(F.col("x"), win.series("k", "i")).alias("p")).orderBy("i").select("p").collect()] == pytest.approx(want)


def test_annual_bundle_by_a_loop(spark):
    """Every date's bundle by a plain search over all facts: half-year flows, restatements, stocks after the year's end."""
    rng = np.random.default_rng(9)
    rows = []
    for y in range(2010, 2016):
        end = D(y, 12, 31)
        for concept, flow in (("revenue", True), ("net_income", True), ("cash", False)):
            for _ in range(rng.integers(1, 4)):
                filed = end + datetime.timedelta(days=int(rng.integers(20, 700)))
                rows.append((1, concept, D(y, 1, 1) if flow else None, end, filed, float(rng.normal())))
                if flow:
                    rows.append((1, concept, D(y, 7, 1), end, filed, 1e6))
        rows.append((1, "cash", None, D(y + 1, 6, 30), D(y + 1, 7, 15), float(rng.normal())))
    grid = [D(2010, 1, 1) + datetime.timedelta(days=45 * i) for i in range(60)]
    want = {}
    for day in grid:
        newest = {}
        for _, concept, start, end, filed, value in rows:
            if filed <= day and (start is None or 350 <= (end - start).days <= 380):
                newest[concept] = max(newest.get(concept, (D(1, 1, 1), D(1, 1, 1), 0.0, None)), (end, filed, value, start), key=lambda x: x[:2])
        if "revenue" in newest:
            anchor = newest["revenue"][0]
            want[day] = {c: v for c, (end, _, v, start) in newest.items() if (end == anchor if start else end <= anchor)}
    facts = spark.createDataFrame(rows, "cik int, concept string, period_start date, period_end date, filed date, value double")
    dates = spark.createDataFrame([(x,) for x in grid], "as_of date")
    got = {r.as_of: {c: r[c] for c in ("revenue", "net_income", "cash") if r[c] is not None} for r in factors.latest_annual(facts, dates, ["revenue", "net_income", "cash"]).collect()}
    assert got == want and len({len(v) for v in want.values()}) > 1


def test_newey_west_by_numpy(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 60)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double")
    d = x - x.mean()
    var = d @ d / 60 + sum(2 * (1 - k / 4) * (d[k:] @ d[:-k]) / 60 for k in (1, 2, 3))
    assert stats.newey_west(df, ["g"], "i", "x", 3, 3).first().nw_t == pytest.approx(x.mean() / np.sqrt(var / 60))
    flat = spark.createDataFrame([(1, i, 0.0) for i in range(5)], "g int, i int, x double")
    assert stats.newey_west(flat, ["g"], "i", "x", 3, 3).first().nw_t == 0.0


def test_hac_regression_by_numpy(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=(120, 2)), rng.normal(size=120)
    y = 0.5 + x @ [1.5, -2.0] + e
    df = spark.createDataFrame([("a", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(120)], "g string, i int, y double, x1 double, x2 double")
    r = stats.ols_hac(df, ["g"], "i", "y", ["x1", "x2"], 4, 80).first()
    m = np.column_stack([np.ones(120), x])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    s = m * (y - m @ b)[:, None]
    h = s.T @ s + sum((1 - k / 5) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in range(1, 5))
    inv = np.linalg.inv(m.T @ m)
    t = b / np.sqrt(np.diag(inv @ h @ inv))
    assert [r.beta_const, r.beta_x1, r.beta_x2] == pytest.approx(b)
    assert [r.t_const, r.t_x1, r.t_x2] == pytest.approx(t)
    assert r.dominant == "x2"
    odd = df.withColumns({"rare": F.when(F.col("i") < 40, F.col("x1")), "flat": F.lit(3.0), "gap": F.when(F.col("i") >= 5, F.col("x2"))})
    left_out = stats.ols_hac(odd, ["g"], "i", "y", ["x1", "x2", "rare", "flat"], 4, 80).first()
    assert (left_out.beta_x1, left_out.t_x2, left_out.r2_adj) == pytest.approx((r.beta_x1, r.t_x2, r.r2_adj)) and left_out.n_drivers == 2 and left_out.n_obs == 120
    assert left_out.beta_rare == left_out.t_flat == 0 and stats.ols_hac(odd, ["g"], "i", "y", ["x1", "gap"], 4, 80).first().n_obs == 115
    assert stats.ols_hac(odd, ["g"], "i", "y", ["rare", "flat"], 4, 80).count() == 0


def world(spark, leak: float):
    rng = np.random.default_rng(5)
    days = [D(2020, 1, 1) + datetime.timedelta(days=int(i)) for i in range(120)]
    level = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (40, 120)), 1))
    rows, sig = [], []
    for n in range(40):
        for i, day in enumerate(days):
            rows.append((f"t{n:02d}", day, float(level[n, i])))
            ahead = level[n, min(i + 6, 119)] / level[n, min(i + 1, 119)] - 1
            sig.append((f"t{n:02d}", day, float(leak * ahead + (1 - leak) * rng.normal(0, 0.05))))
    return spark.createDataFrame(sig, "ticker string, date date, value double"), spark.createDataFrame(rows, "ticker string, date date, close double")


@pytest.mark.parametrize("leak, low, high", [(1.0, 3.0, 1e9), (0.0, -3.0, 3.0)])
def test_walk_forward_controls(spark, leak, low, high):
    """A leaked signal must show, noise must not."""
    periods, _ = backtest.walk_forward(*world(spark, leak), every=5, min_names=20, max_stale_days=5)
    s = backtest.summary(periods, 50.0).first()
    assert low < s.sharpe_gross < high
    first = periods.orderBy("k").first()
    assert first.turnover == 1.0 and first.cost == pytest.approx(0.012)


def test_subsample_counts_with_embargo(spark):
    df = spark.createDataFrame([(D(2019, 1, 1) + datetime.timedelta(days=30 * i), 0.01) for i in range(90)], "date date, ls_gross double")
    got = {r.window: r.n for r in backtest.subsamples(df).collect()}
    assert [got[f"third {i}/3"] for i in (1, 2, 3)] == [29, 28, 29]


def test_snapshot_diff(spark):
    make = lambda rows: spark.createDataFrame(rows, "ticker string, pctl double")
    before, after = make([("A", 0.95), ("B", 0.5), ("C", 0.92), ("D", 0.1)]), make([("A", 0.94), ("B", 0.96), ("C", 0.6), ("D", 0.8)])
    assert sorted((r.ticker, r.kind) for r in factors.snapshot_diff(before, after).collect()) == [("B", "entrant"), ("C", "exit"), ("D", "jump")]


def test_graph_momentum_direction(spark):
    t = spark.createDataFrame([("crude", D(2024, 1, 1), 0.5), ("refining", D(2024, 1, 1), 0.0)], "basket string, date date, ret double")
    e = spark.createDataFrame([("crude", "refining"), ("crude", "crude")], "src string, dst string")
    got = {r.basket: (r.up, r.down) for r in baskets.graph_momentum(t, e).collect()}
    assert got == {"refining": (0.5, None), "crude": (None, 0.0)}


def test_leave_one_out(spark):
    r = spark.createDataFrame([("a", 1, D(2024, 1, 1), 0.1), ("b", 1, D(2024, 1, 1), 0.3), ("c", 1, D(2024, 1, 1), None)], "ticker string, basket int, date date, ret double")
    got = {x.ticker: x.loo for x in baskets.leave_one_out(r).collect()}
    assert got == {"a": pytest.approx(0.3), "b": pytest.approx(0.1), "c": pytest.approx(0.2)}


def test_weekly_grid_keeps_empty_weeks(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 3), 1.0), ("a", D(2024, 1, 17), 2.0)], "ticker string, date date, close double")
    assert [(r.week, r.close) for r in panel.weekly_last(p, "ticker", "close").orderBy("week").collect()] == [(D(2024, 1, 5), 1.0), (D(2024, 1, 12), None), (D(2024, 1, 19), 2.0)]


def test_summary_names_the_smaller_key_first_across_blocks(spark):
    """In blocks of two series most pairs meet across blocks; of equal correlations the smallest keys count."""
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = [(k, 1, D(2024, 1, 1 + i), base[k % 4][i]) for k in range(1, 13) for i in range(12)]  # three copies of each of four
    r = spark.createDataFrame(rows, "ticker int, basket int, date date, ret double")
    got = screen.group_summary(screen.series_rows(r, "ticker", "date", "ret", "basket"), "basket", 5, block=2).first()
    pairs = {(a, b): round(float(np.corrcoef(base[a % 4], base[b % 4])[0, 1]), 9) for a in range(1, 13) for b in range(a + 1, 13)}
    low, high = min(pairs, key=lambda p: (pairs[p], p)), min(pairs, key=lambda p: (-pairs[p], p))
    assert (got.n_pairs, got.min_pair, got.max_pair) == (66, f"{low[0]}-{low[1]}", f"{high[0]}-{high[1]}")
    assert got.min_corr == pytest.approx(pairs[low]) and got.max_corr == pytest.approx(1.0)


def test_screen_in_tiles_by_loop(spark, monkeypatch):
    """Series with and without gaps, in tiles of four and cut after few pairs; a series travels once for each wide block."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(23, 40)) + rng.normal(size=40)
    x[5] = x[4]
    x[::3, 7] = np.nan
    x[11, 20:] = np.nan
    days = [D(2024, 1, 1) + datetime.timedelta(i) for i in range(40)]
    rows = [("stock", k, days[i], float(x[k, i]), None) for k in range(23) for i in range(40) if not np.isnan(x[k, i])]
    df = spark.createDataFrame(rows, "kind string, key long, date date, ret double, home array<long>")
    series = screen.series_rows(df, "key", "date", "ret", "kind", "home")
    both = {(a, b): ~np.isnan(x[a]) & ~np.isnan(x[b]) for a in range(23) for b in range(a + 1, 23)}
    corr = {p: float(np.corrcoef(x[p[0]][m], x[p[1]][m])[0, 1]) for p, m in both.items() if m.sum() >= 25}
    want = sorted(corr, key=lambda p: (-round(abs(corr[p]), 9), p))[:30]
    monkeypatch.setattr(screen, "TILE", 4)
    monkeypatch.setattr(screen, "HELD", 40)
    got = {(r.a, r.b): (r.n, r["corr"]) for r in screen.strongest_pairs(series, least=25, floor=0.0, top=30, block=12).collect()}
    assert set(got) == set(want) and all(got[p] == (both[p].sum(), pytest.approx(corr[p])) for p in want)
    parts = pd.concat([series.toPandas().assign(_lo=0, _hi=0, _i=0)])
    found = screen._strongest(25, 0.0, 30)(parts)
    assert list(zip(found["a"], found["b"], strict=True)) == want


def test_weekly_grid_starts_with_an_unknown_week(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 3), None), ("a", D(2024, 1, 9), 1.0), ("a", D(2024, 1, 10), None)], "ticker string, date date, close double")
    assert [(r.week, r.close) for r in panel.weekly_last(p, "ticker", "close").orderBy("week").collect()] == [(D(2024, 1, 5), None), (D(2024, 1, 12), 1.0)]


@pytest.fixture
def zero_events(spark, tmp_path):
    """A user's purchases on Wednesdays: 2, 0, 0, 3, then a null after 5 on the same day."""
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    rows = [(0, at(3, 9), 2.0), (1, at(10, 9), 0.0), (2, at(17, 9), 0.0), (3, at(24, 9), 3.0), (4, at(31, 9), 5.0), (5, at(31, 10), None)]
    spark.createDataFrame([(i, t, 7, "purchase", v) for i, t, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_weekly_returns_around_zero(spark, zero_events):
    got = [(r.close, r.ret) for r in QUERIES["ts_resample_wfri"](spark, zero_events).orderBy("week").collect()]
    assert [c for c, _ in got] == [2.0, 0.0, 0.0, 3.0, 5.0]
    assert (got[0][1], got[1][1], got[3][1], got[4][1]) == (None, -math.inf, math.inf, round(math.log(5 / 3), 6)) and math.isnan(got[2][1])


def test_index_passes_over_zero(spark, zero_events):
    """A day worth nothing counts as 1, as does the day after it."""
    got = [r.log_index for r in QUERIES["win_tr_index"](spark, zero_events).orderBy("date").collect()]
    assert got == pytest.approx([0.0, 0.0, 0.0, 0.0, math.log10((5 + 5) / 3)], abs=1e-6)


def test_screen_keeps_weak_pairs(spark, sf_dir):
    """The strongest 500 of all, also those under 0.4."""
    got = QUERIES["agg_corr_screen"](spark, sf_dir).collect()
    assert len(got) == 45 and min(abs(r["corr"]) for r in got) < 0.4  # ten suppliers


def test_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 4.0])], "k string, date int, x double")
    w = win.series("k")
    assert [r[0] for r in df.select(win.rolling_z(F.col("x"), w, 3)).collect()] == [None, None, 0.0, pytest.approx(2 / 3**0.5)]
    assert [r[0] for r in df.select(win.average_rank(F.col("x"))).collect()] == [2.0, 2.0, 2.0, 4.0]


def test_greeks_and_implied_vol(spark):
    base = dict(spot=42.0, strike=40.0, t=0.5, rate=0.10, div=0.0, vol=0.20)
    c = spark.createDataFrame([base | {"type": "c"}, base | {"type": "p"}])
    got = {r.type: r for r in options.implied_vol(options.greeks(c), "price").collect()}
    assert got["c"].price == pytest.approx(4.7594, abs=1e-3) and got["p"].price == pytest.approx(0.8086, abs=1e-3)
    assert got["c"].price - got["p"].price == pytest.approx(42 - 40 * np.exp(-0.05), abs=1e-9)
    assert got["c"].iv == pytest.approx(0.2, abs=1e-5) and got["p"].iv == pytest.approx(0.2, abs=1e-5)
    h = 0.01
    up, down = (options.greeks(spark.createDataFrame([base | {"type": "c", "spot": 42 + x}])).first() for x in (h, -h))
    assert (up.price - down.price) / (2 * h) == pytest.approx(got["c"].delta, abs=1e-5)
    outside = spark.createDataFrame([base | {"type": "c", "mid": 50.0}])
    assert options.implied_vol(outside).first().iv is None


def test_options_without_time_or_vol(spark):
    base = dict(spot=42.0, strike=40.0, t=0.5, rate=0.10, div=0.02, vol=0.0, type="c")
    rows = [base, base | {"type": "p", "strike": 50.0}, base | {"t": 0.0, "vol": 0.2}, base | {"t": -1.0, "vol": 0.2, "type": "p"}]
    got = [(r.price, r.delta, r.gamma, r.theta) for r in options.greeks(spark.createDataFrame(rows)).collect()]
    forward, paid = 42 * np.exp(-0.01), np.exp(-0.05)
    assert got == [(pytest.approx(forward - 40 * paid), 1.0, 0.0, 0.0), (pytest.approx(50 * paid - forward), -1.0, 0.0, 0.0), (2.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]


def test_all_templates_and_books(spark, sf_dir):
    legs = desk_plans.legs(spark, sf_dir).where("symbol < 5").withColumn("book", F.concat_ws(":", "symbol", "template")).persist()
    rows = legs.collect()
    assert {r.template for r in rows} == set(options.TEMPLATES) and len(rows) == 5 * sum(map(len, options.TEMPLATES.values()))
    later = [r.dte for r in rows if r.template == "Call calendar"]
    assert set(later) == {30, 365}
    totals = {r.book: r for r in options.leg_greeks(legs).where("leg IS NULL").collect()}
    parts = options.leg_greeks(legs).where("leg IS NOT NULL").collect()
    assert totals["3:Collar"].delta == pytest.approx(sum(r.delta for r in parts if r.book == "3:Collar"))
    assert next(r.delta for r in parts if r.book == "3:Covered call" and r.leg == 1) == 100.0  # the underlying
    still = {r.book: r.pnl for r in options.risk_grid(legs, [0.0], [0.0]).collect()}
    assert still == pytest.approx({k: r.pnl for k, r in totals.items()})
    small = options.sigma_split(legs, [0.01]).collect()
    assert all(abs(r.rest) < 1e-3 * max(1.0, abs(r.delta_part)) for r in small)
    profile = {r.book: r for r in options.expiry_profile(options.expiry_curve(legs)).collect()}
    call = next(r for r in rows if r.book == "2:Long call")
    assert profile["2:Long call"].max_loss == pytest.approx(-100 * call.entry, rel=1e-6) and profile["2:Long call"].unlimited_profit
    assert profile["2:Long call"].breakevens == pytest.approx([call.strike + call.entry], rel=1e-6)
    assert len(profile["2:Long straddle"].breakevens) == 2 and 0 < profile["2:Long straddle"].p_profit < 1
    assert profile["2:Short straddle"].unlimited_loss and profile["2:Call ratio 1x2"].unlimited_loss and profile["2:Call ratio 1x2"].max_loss is None
    assert profile["2:Long straddle"].p_profit + profile["2:Short straddle"].p_profit < 1  # both pay the spread
    assert not profile["2:Iron condor"].unlimited_loss and profile["2:Call calendar"].breakevens


def test_expiry_profile_by_loop(spark):
    """Against a fine grid and its own tails, and by the formula where the payoff is known."""
    norm = statistics.NormalDist()
    rng = random.Random(5)
    books = {"short call": [("c", 100.0, -1, 3.0)], "naked put": [("p", 90.0, -1, 2.0)], "stock": [("u", 0.0, 1, 101.0)], "covered": [("u", 0.0, 1, 100.0), ("c", 110.0, -1, 4.0)]}
    for i in range(25):
        books[f"r{i}"] = [(rng.choice("cpu"), float(rng.randrange(70, 130, 5)), rng.choice([-2, -1, 1, 2]), round(rng.uniform(0.5, 12), 2)) for _ in range(rng.randint(1, 4))]
    t, vol, rate, div, spot = 0.25, 0.3, 0.02, 0.01, 100.0
    rows = [{"book": b, "leg": n, "type": ty, "strike": k, "t": 0.0 if ty == "u" else t, "qty": q, "vol": 0.0 if ty == "u" else vol, "entry": 98.0 + e if ty == "u" else e, "spot": spot, "rate": rate, "div": div} for b, legs in books.items() for n, (ty, k, q, e) in enumerate(legs)]
    got = {r.book: r for r in options.expiry_profile(options.expiry_curve(spark.createDataFrame(rows))).collect()}
    for b, legs in books.items():
        own = [r for r in rows if r["book"] == b]
        live = any(ty != "u" for ty, *_ in legs)

        def pnl(s, own=own):
            return sum(100 * r["qty"] * ({"c": max(s - r["strike"], 0), "p": max(r["strike"] - s, 0), "u": s}[r["type"]] - r["entry"]) for r in own)

        slope = 100 * sum(q for ty, _, q, _ in legs if ty != "p")
        ks = [0.0] + [k for ty, k, _, _ in legs if ty != "u"]
        assert got[b].unlimited_profit == (slope > 0) and got[b].unlimited_loss == (slope < 0)
        if slope <= 0:
            assert got[b].max_profit == pytest.approx(max(map(pnl, ks)), abs=1e-2)
        if slope >= 0:
            assert got[b].max_loss == pytest.approx(min(map(pnl, ks)), abs=1e-2)
        assert all(abs(pnl(x)) < 1e-2 for x in got[b].breakevens)
        if live:
            mu, sd = math.log(spot) + (rate - div - vol * vol / 2) * t, vol * math.sqrt(t)
            cut = [0.01 * i for i in range(1, 100_000)]
            changes = sum((pnl(x) > 0) != (pnl(y) > 0) for x, y in zip(cut[::25], cut[25::25]))
            assert len(got[b].breakevens) >= changes
            edges = [0.0, *got[b].breakevens, 1e9]
            below = lambda x: norm.cdf((math.log(x) - mu) / sd) if x > 0 else 0.0
            want = sum(below(y) - below(x) for x, y in zip(edges, edges[1:]) if pnl((x + min(y, 2 * x + 1000)) / 2) > 0)
            assert got[b].p_profit == pytest.approx(want, abs=1e-6), b


def test_books_stay_where_their_symbol_is(spark, sf_dir):
    """Only parts and quotes move; books are neither stored nor shuffled."""
    for name in ("opt_leg_match", "opt_leg_greeks", "opt_risk_grid", "opt_sigma_split", "opt_expiry_profile"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 1, name


def test_position_fold_by_hand(spark):
    day = [(0, 0.9, 100.0), (1, 0.5, 100.0), (2, None, 90.0), (3, 0.505, 95.0), (4, 0.8, 96.0), (5, 0.8, 79.0), (6, -0.4, 80.0), (7, 0.3, 81.0), (8, 0.3, 82.0), (9, 0.3, 83.0), (10, 0.3, 84.0), (11, 0.0, 84.0)]
    rows = [("a", i, z, p, 0.1, 3) for i, z, p in day]
    df = spark.createDataFrame(rows, "k string, i int, target double, price double, stop double, max_hold int")
    got = [(r.pos, r.reason) for r in lab.fold(df, ["k"], "i").orderBy("i").collect()]
    assert got == [(0.0, None), (0.5, "entry"), (0.5, None), (0.5, None), (0.0, "max_hold"), (0.8, "entry"), (-0.4, "flip"), (0.3, "flip"), (0.3, None), (0.3, None), (0.0, "max_hold"), (0.0, None)]
    fall = spark.createDataFrame([("a", i, 1.0, p, 0.1, 99) for i, p in enumerate([100.0, 100.0, 95.0, 89.0])], df.schema)
    assert [r.reason for r in lab.fold(fall, ["k"], "i").orderBy("i").collect()] == [None, "entry", None, "stop"]
    ret = spark.createDataFrame([("a", i, p, r) for i, (p, r) in enumerate([(0.0, 0.1), (1.0, 0.1), (1.0, 0.2), (0.5, 0.1), (0.5, -0.4)])], "k string, i int, pos double, ret double")
    done = [(r.entry_at, r.exit_at, r.side, r.rows, round(r.pnl, 9)) for r in lab.trades(ret, ["k"], "i").orderBy("entry_at").collect()]
    assert done == [(1, 3, 1.0, 2, round(0.3 - 0.001, 9)), (3, None, 1.0, 1, round(-0.2 - 0.0005, 9))]
    m = lab.metrics(lab.pnl(ret, ["k"], "i"), ["k"], "i", 52.0).first()
    assert (m.n_trades, m.win_rate, m.avg_hold) == (2, 0.5, 1.5)


def test_folds_of_many_series_are_one_stream(spark):
    """No group of its own for a series, whose state passes over batches and ends with it."""
    day = [(0, 0.9, 100.0), (1, 0.5, 100.0), (2, None, 90.0), (3, 0.8, 96.0), (4, -0.4, 80.0)]
    df = spark.createDataFrame([(k, i, z, p, 0.5, 9, i * 0.1) for k in range(50) for i, z, p in day], "k int, i int, target double, price double, stop double, max_hold int, ret double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = lab.fold(df, ["k"], "i", keep=("ret",))
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(0.0, None), (0.5, "entry"), (0.5, None), (0.8, "scale_in"), (-0.4, "flip")]
    assert got == [(k, i, i * 0.1, *want[i]) for k in range(50) for i in range(5)]


def test_bootstrap_totals_have_the_length_of_the_series(spark):
    ones = spark.createDataFrame([("a", i, 1.0) for i in range(10)] + [("b", i, 1.0) for i in range(3)], "k string, i int, pnl double")
    got = {(r.k, r.total) for r in lab.bootstrap(ones, ["k"], "i", 20, 4, "s").collect()}
    assert got == {("a", 10.0), ("b", 3.0)}


def test_bootstrap_by_loop_without_a_join(spark):
    """Runs times blocks are far more rows than a series has; a join could broadcast them."""
    rng = random.Random(1)
    series = {"a": [rng.gauss(0, 1) for _ in range(11)], "b": [rng.gauss(0, 1) for _ in range(4)], "c": [1.5]}
    df = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "k string, i int, pnl double")
    out = lab.bootstrap(df, ["k"], "i", 30, 4, "7")
    assert "Join" not in out._jdf.queryExecution().toString()
    got = {(r.k, r.run): r.total for r in out.collect()}
    for k, xs in series.items():
        for run in range(30):
            total, left, b = 0.0, len(xs), 0
            while left > 0:
                start = int(hashlib.md5(f"7:{run}:{b}".encode()).hexdigest()[:8], 16) % max(1, len(xs) - 4)
                total += sum(xs[start : start + min(4, left)])
                left, b = left - 4, b + 1
            assert got.pop((k, run)) == pytest.approx(total)
    assert not got


def test_workbench_order_and_functions(spark):
    df = spark.createDataFrame([(1, "Oil", 2.0), (2, "gas", None), (3, "Coal", 6.0), (4, "5", 2.0), (5, "tin", 0.0)], "id int, name string, x double")
    assert workbench.find(df, "OIL").count() == 1
    assert [r.id for r in workbench.where(df, "x > 1").orderBy("id").collect()] == [1, 3, 4]
    assert [r.id for r in workbench.where(df, "CAST(name AS INT) > 1 OR 4 / x > 1.5").orderBy("id").collect()] == [1, 4]  # bad cells and a zero
    column = lambda text: [r.y for r in workbench.formula(df, "y", text, [F.col("id")]).orderBy("id").collect()]
    assert column("CUM(x)") == [2.0, 2.0, 8.0, 10.0, 10.0] and column("RANK(x)") == [2.0, None, 1.0, 3.0, 4.0]
    assert column("6 / x") == [3.0, None, 1.0, 3.0, None] and column("CAST(name AS DOUBLE) + x") == [None, None, None, 7.0, None]
    assert column("MA(x, 2)") == [None, None, None, 4.0, 1.0] and column("SD(x, 2)")[3] == pytest.approx(8**0.5)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_signals_want_their_measures(spark):
    wide = spark.createDataFrame([("n", 2.0, 0.7, -0.2), ("m", None, 0.1, 0.05)], "node string, residual_z double, dispersion double, peer_gap double")
    got = {(r.node, r.type): (r.firing, round(r.score, 3), r.direction) for r in signals.stack(wide, ["node"], signals.STOCK_SIGNALS).collect()}
    assert got["n", "residual"] == (True, 0.667, -1) and got["n", "attribution"] == (True, 0.7, 0) and got["n", "peer"] == (True, 0.667, -1)
    assert got["m", "residual"] == (False, 0.0, 0) and got["m", "peer"] == (False, 0.167, 0)
    with pytest.raises(ValueError, match="dispersion"):
        signals.stack(wide.drop("dispersion"), ["node"], signals.STOCK_SIGNALS)


def test_attribution_windows(spark):
    days = [D(2023, 11, 3) + datetime.timedelta(days=7 * i) for i in range(20)]
    r = spark.createDataFrame([("e", x, 0.01 * i) for i, x in enumerate(days)], "entity string, date date, ret double")
    moves = spark.createDataFrame([(s, x, 0.01 if s == "oil" else None) for x in days for s in ("oil", "gas")], "symbol string, date date, change double")
    betas = spark.createDataFrame([("e", "oil", 2.0), ("e", "gas", float("nan"))], "entity string, symbol string, beta double")
    parts = baskets.contributions(r, moves, betas)
    assert {(x.window, x.symbol): round(x.contribution, 9) for x in parts.collect()} == {(w, s): round(0.02 * n, 9) if s == "oil" else 0.0 for w, n in (("1m", 4), ("3m", 13), ("ytd", 11), ("1y", 20)) for s in ("oil", "gas")}
    total = {x.window: x for x in baskets.attribution(r, parts).collect()}
    assert total["1m"].actual == pytest.approx(0.01 * (16 + 17 + 18 + 19)) and total["1m"].idio == pytest.approx(0.7 - 0.08) and total["1m"].top_driver == "oil"


def test_balance_blocs_and_sites(spark):
    s = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 2.0), ("a", 2, 5.0), ("b", 2, None)], "series string, month int, value double")
    signs = spark.createDataFrame([("net", "a", 1), ("net", "b", -1)], "bloc string, series string, sign int")
    assert {r.month: r.value for r in balance.bloc_sums(s, signs, ["month"]).collect()} == {1: 3.0, 2: None}
    pts = spark.createDataFrame([(1, "k", 0.0, 0.0), (2, "k", 0.1, 0.1), (3, "k", 0.5, 0.5)], "id int, kind string, lon double, lat double")
    near = spark.createDataFrame([(9, "k", -0.05, 0.0)], "id int, kind string, lon double, lat double")
    assert {r.id for r in balance.near_curated(pts, near, 0.2).collect()} == {3}


def test_scalar_cells(spark):
    df = spark.createDataFrame([("$1,200.5",), ("--",), ("5 %",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.clean_number(F.col("t"))).collect()] == [1200.5, None, 5.0, None, None]
    assert spark.range(1).select(scalars.smart_title(F.lit("USA STEEL MILL"))).first()[0] == "USA Steel Mill"


def test_text_rules_by_loop(spark):
    """Cleaning, titles and units against loops over their branches."""
    rng = random.Random(9)
    pool = ["ACME", "Oil", "LLC", "\x01", "\t", " ", "  ", "\u00a0", "–", "—", "\x97", "\u00ad", "PG&E", "&B", "(USA),", "É", "mc", "\x7f", "\u2003", "ß", "CO."]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(400)] + [None, "McGraw", "ACME OIL LLC", "a\x01b"]

    def clean(s):
        if s is None:
            return None
        out = []
        for ch in s:
            o = ord(ch)
            if o in (0x2013, 0x2014, 0x96, 0x97):
                out.append("-")
            elif not (o < 32 or 127 <= o <= 159 or o == 0xAD):
                out.append(" " if ch.isspace() else ch)
        return " ".join("".join(out).split(" ")).strip() and " ".join("".join(out).split()) or None

    def title(s):
        s = clean(s)
        if s is None or any(c != u for c, u in zip(s, s.upper())) or len(s) != len(s.upper()):
            return s
        words = []
        for w in s.split(" "):
            core = w.strip(".,()")
            words.append(w if core in scalars.KEEP_UPPER or ("&" in core and len(core) < 3) else w[:1].upper() + w[1:].lower())
        return " ".join(words)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", scalars.clean_text(F.col("t")).alias("a"), scalars.smart_title(F.col("t")).alias("b")).collect()}
    assert got == {i: (clean(t), title(t)) for i, t in enumerate(texts)}
    units = [(50.0, "metric tons"), (50.0, "kg"), (-3.0, "thousand tons"), (0.0, "t/yr"), (None, "kg"), (2.0, None), (2.0, "Thousand 42-gallon barrels"), (2.0, "thousand tons"), (2.0, "tons"), (2.0, "t / y"), (2.0, "Million tons"), (7.0, "KILOGRAMS of metal"), (7.0, "thousand carats")]
    want = [(0.05, "kt/yr"), (0.05, "t/yr"), *[(None, None)] * 5, (2.0, "kt/yr"), (None, None), (0.002, "kt/yr"), (None, None), (0.007, "t/yr"), (None, None)]
    df = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "i int, c double, u string")
    assert [tuple(r.x) for r in df.select("i", scalars.unit_norm(F.col("c"), F.col("u")).alias("x")).orderBy("i").collect()] == want


def test_facilities_by_loop(spark):
    """Every branch of the table, by nested ifs."""
    types = ["Smelter at mine site", "Mine", "Quarry", "Mill", "Plant", "REFINERY", "", None, "Old mine"]
    texts = ["copper", "copper ore", "gold", "alumina", "alumina compound", "bauxite", "iron ore", "uranium", "platinum, tin", "tin", "zinc metal", "aluminum", "aluminum mine", "aluminium, gold", "lead, gold", "sand", None, "ferronickel", "steel", "steel, iron ore", "nickel smelter", "refined cobalt", "rare earth oxide", "secondary copper", "plating of zn"]

    def kind(f, com, first):
        f, com = (f or "").lower(), (com or "").lower()
        if "smelter" in f + "|" + com:
            return "smelter"
        if "refin" in f + "|" + com:
            return "metal_refinery"
        if f[:4] in ("mine", "mill") or f[:6] == "quarry":
            return "mine"
        if any(x in com for x in ("ore", "concentrate", "mine")) or first in ("bauxite", "iron_ore", "uranium"):
            return "mine"
        if first == "alumina" or any(x in com for x in ("metal", "cathode", "electrowinning", "carbonate", "oxide", "compound")):
            return "metal_refinery"
        return "metal_refinery" if first in ("gold", "pgm", "cobalt", "lithium", "rare_earths") else "smelter"

    rows = [(i, t, c) for i, (t, c) in enumerate((t, c) for t in types for c in texts)]
    got = {r.i: r for r in rules.facilities(spark.createDataFrame(rows, "i int, fac_type string, commodity string")).collect()}
    assert len(got) == len(rows)
    for i, t, c in rows:
        places = sorted((m.start(), n) for n, p in rules.COMMODITIES.items() if (m := re.search(p, c or "")))
        first = places[0][1] if places else None
        k = kind(t, c, first)
        assert got[i].kind == k, (t, c)
        assert got[i].primary == ("bauxite" if first == "aluminum" and k == "mine" else first)
        bad = any(x in (c or "") for x in ("ferro", "secondary")) or "steel" in (c or "") and "iron ore" not in c
        assert got[i].wanted == (first not in (None, "lead", "silver") and not bad)
        assert got[i].also == [n for _, n in places[1:] if n != got[i].primary]
    line = [(-100.0, 49.05), (-97.4, 25.7)], [(-100.0, 49.06)], [(-80.0, 42.9)], [(-80.0, 43.0)], [(-73.0, 45.06)], [(-97.2, 20.0)], []
    df = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in pts]) for i, pts in enumerate(line)], "i int, p array<struct<lon:double,lat:double>>")
    assert [r[0] for r in df.orderBy("i").select(rules.border_countries(F.col("p"), rules.BORDERS)).collect()] == [["USA", "MEX"], ["USA", "CAN"], ["USA"], ["USA", "CAN"], ["USA", "CAN"], ["USA"], ["USA"]]


def test_integrity_rules_by_hand(spark):
    keys = spark.createDataFrame([("A",), ("B",), ("B",)], "code string")
    rows = [("x", 1, "A", 5.0, 0.5, 10.0, "001"), ("x", 2, "OTH", 5.0, 0.45, 10.0, "01"), ("y", 1, "C", 2.0, 0.5, 7.2, None), ("y", 2, "B", 5.0, 0.6, 7.2, "123"), ("z", 1, "A", None, None, None, "4567")]
    df = spark.createDataFrame(rows, "g string, rank int, holder string, amount double, share double, whole double, iso string")
    by = ("g",)
    checks = {"known": rules.Known("holder", keys, "code", ("OTH",)), "iso": rules.Matches("iso", "[0-9]{3}"), "amount": rules.Within("amount", 0, 4.0), "pair": rules.Together("amount", "iso"), "falls": rules.Falls(by, "rank", "amount"), "sum": rules.AddsUp(by, "amount", "whole"), "share": rules.SumWithin(by, "share")}
    got = {(r.rule, r.id, None if r.number is None else round(r.number, 6), r.text) for r in rules.violations(df, ["g", "rank"], checks).collect()}
    assert got == {
        ("known", "y:1", None, "C"), ("iso", "x:2", None, "01"), ("iso", "y:1", None, None), ("iso", "z:1", None, "4567"), ("amount", "x:1", 5.0, None), ("amount", "x:2", 5.0, None), ("amount", "y:2", 5.0, None), ("amount", "z:1", None, None),
        ("pair", "y:1", None, "2.0"), ("pair", "z:1", None, "4567"), ("falls", "y", 5.0, None), ("share", "y", 1.1, None),
    }


def test_facts_json_takes_the_first_tag(spark, tmp_path):
    item = {"end": "2024-03-31", "fy": 2024, "fp": "Q1", "form": "10-Q/A", "accn": "x", "filed": "2024-05-01", "val": 1.5}
    (tmp_path / "CIK0000000007.json").write_text(json.dumps({"facts": {"us-gaap": {"B": {"units": {"USD": [item]}}, "A": {"units": {"USD": [item | {"val": 2.0}]}}}}}))
    (tmp_path / "CIK0000000008.json").write_text("{broken")
    docs = readers.json_documents(spark, str(tmp_path))
    chains = spark.createDataFrame([("rev", "A", 0), ("rev", "B", 1)], "concept string, tag string, place int")
    rows = readers.facts(docs, chains).collect()
    assert [(r.cik, r.concept_used, r.value, r.is_amendment, r.period_start) for r in rows] == [(7, "A", 2.0, True, D(2024, 3, 31))]


def test_series_lines_raise_on_missing(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"series_id": "S1", "data": [["202401", "1.5"], ["202402", null]]}\n')
    assert readers.series_lines(spark, str(tmp_path), ["S1"]).count() == 2
    with pytest.raises(ValueError, match="S2"):
        readers.series_lines(spark, str(tmp_path), ["S1", "S2"])


def test_ranges_of_a_cross_section(spark):
    """Ranks, buckets and quantiles without gathering a date: the same as the windows, and dealt out."""
    rng = random.Random(2)
    rows = [(f"t{i:04d}", D(2024, 1, 1 + i % 2), 7.0 if i % 3 == 0 else round(rng.gauss(0, 5), 1)) for i in range(3000)] + [("a", D(2024, 2, 1), 1.0), ("b", D(2024, 2, 1), None), ("c", D(2024, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, x double").repartition(6)
    order = [F.col("x").desc(), F.col("ticker")]
    got = cross_section.ordinal_rank(df, ["date"], order, "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("date").orderBy(*order)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumn("n", F.col("n").cast("long")).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt = cross_section.placed(df, ["date"], order).withColumn("p", F.spark_partition_id()).groupBy("date", "p").count().groupBy("date").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["count"] > 1 for r in dealt if r.date.month == 1)
    got = cross_section.quantile_bucket(df, ["date"], "x", "ticker", 5, "q").collect()
    assert sorted(map(str, got)) == sorted(map(str, df.withColumn("q", win.quantile_bucket(F.col("x"), 5, "date")).collect()))
    got = {(r.ticker, r.date): r.w for r in cross_section.winsorised(df, ["date"], "x", "ticker", "w", 0.05).collect()}
    want = {(r.ticker, r.date): r.w for r in df.withColumn("w", win.winsorised(F.col("x"), "date", cut=0.05)).collect()}
    assert got.keys() == want.keys() and all(a == pytest.approx(want[k]) for k, a in got.items())
    known = df.where("x IS NOT NULL")
    got = cross_section.average_rank(known, ["date"], "x", "ticker", "r").collect()
    assert sorted(map(str, got)) == sorted(map(str, known.withColumn("r", win.average_rank(F.col("x"), "date")).collect()))
    signal = df.withColumnRenamed("x", "value")
    ahead = known.select("ticker", "date", F.lit(1).alias("horizon"), (F.col("x") + F.length("ticker") + F.rand(1)).alias("fwd"))
    one, two = ({(r.date, r.horizon): (round(r.ic, 9), r.n_names) for r in stats.daily_ic(signal, ahead, 20, huge=h).collect()} for h in (0, 10**9))
    assert one == two and len(one) == 2


def test_asof_by_buckets(spark):
    rng = random.Random(4)
    prices = [("k" if rng.random() < 0.8 else f"k{rng.randint(0, 3)}", D(2024, 1, 1) + datetime.timedelta(rng.randint(0, 400)), rng.choice([0.0, -1.0, 5.0, 6.5])) for _ in range(600)]
    prices = list({(k, d): (k, d, v) for k, d, v in prices}.values())
    targets = [(i, rng.choice(["k", "k1", "k9"]), D(2023, 12, 1) + datetime.timedelta(rng.randint(0, 460))) for i in range(400)]
    p = spark.createDataFrame(prices, "k string, date date, close double")
    t = spark.createDataFrame(targets, "id int, k string, date date")
    for stale, bucket in ((3, None), (10, 4), (30, 7), (0, None)):
        out = pit.asof_back(t, p, "k", "date", "close", stale, bucket)
        want = {}
        for i, k, d in targets:
            best = max(((pd_, v) for pk, pd_, v in prices if pk == k and v > 0 and 0 <= (d - pd_).days <= stale), default=(None, None))
            want[i] = (best[1], best[0])
        assert {r.id: (r.close, r.found_date) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window " in x)
    assert "_b#" in window.split("windowspecdefinition(")[1]  # dealt by key and bucket


def test_steps_from_the_size(spark):
    df = spark.range(620).select(F.when(F.col("id") < 600, "a").otherwise("b").alias("g"), "id")
    got = sorted((r.g, r.id) for r in panel.every_nth(df, None, ["g"], "id").collect())
    assert got == [("a", i) for i in range(0, 600, 4)] + [("b", i) for i in range(600, 620)]


def test_append_is_idempotent_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, ["k"]) == 3
    assert sinks.append_new(df, path, ["k"]) == 0  # a null key is a key
    assert sinks.append_new(spark.createDataFrame([(2, "x"), (9, "y")], df.schema), path, ["k"]) == 1
    source, path = str(tmp_path / "in"), str(tmp_path / "s")
    stream = lambda: spark.readStream.schema("k int, p string, v string").option("maxFilesPerTrigger", 1).parquet(source)
    for rows in ([(2, "a", "x"), (3, "b", "y")], [(3, "b", "z"), (4, "a", "w"), (3, "a", "other partition")]):
        spark.createDataFrame(rows, "k int, p string, v string").coalesce(1).write.mode("append").parquet(source)
    for cp in ("one", "one", "two"):
        append_stream(stream(), path, ["k", "p"], str(tmp_path / cp), "p").awaitTermination()
        assert sorted((r.k, r.p) for r in sinks.batches(spark, path).collect()) == [(2, "a"), (3, "a"), (3, "b"), (4, "a")]


def test_batches_cut_off_are_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert sinks.append_batch(make([(1, "a")]), path, ["k"], "s_0") == 1
    with monkeypatch.context() as m:  # the data are there, the mark isn't
        m.setattr(sinks, "mark", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.append_batch(make([(1, "b"), (2, "c")]), path, ["k"], "s_1")
    assert [r.k for r in sinks.batches(spark, path).collect()] == [1]
    broken = make([(5, "x"), (6, "y")]).withColumn("v", F.when(F.col("k") == 6, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        sinks.append_batch(broken, path, ["k"], "s_2")
    assert [r.k for r in sinks.batches(spark, path).collect()] == [1]
    assert sinks.append_batch(make([(1, "b"), (2, "c")]), path, ["k"], "s_1") == 1
    assert sinks.append_batch(make([(1, "b"), (2, "c")]), path, ["k"], "s_1") == 0
    assert sinks.append_batch(make([(1, "b")]), path, ["k"], "s_3") == 0
    assert sorted((r.k, r.v) for r in sinks.batches(spark, path).collect()) == [(1, "a"), (2, "c")]


def test_new_keys_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 10).alias("p")).write.partitionBy("p").parquet(path)
    new = spark.createDataFrame([(503, 3), (2003, 3)], "id long, p int")
    held = sinks._held(new, spark.read.parquet(path), ["id", "p"], "p")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,503)" in plan and "PartitionFilters: [isnotnull(p" in plan and [tuple(r) for r in held.collect()] == [(503, 3)]


def test_publish_guard(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "s string, v double")
    path = str(tmp_path / "p")
    assert not sinks.publish(df, path, "s", "v", 2)
    assert sinks.publish(df, path, "s", "v", 1)
    held = sinks.published(spark, path)
    broken = df.withColumn("v", F.when(F.col("s") == "b", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(broken, path, "s", "v", 1)
    assert not sinks.publish(df.where("v IS NULL"), path, "s", "v", 1)  # too little
    assert sinks.published(spark, path).count() == 2
    for v in (2.0, 3.0):
        assert sinks.publish(df.withColumn("v", F.lit(v)), path, "s", "v", 1)
        assert {r.v for r in sinks.published(spark, path).collect()} == {v}
        assert (held.count() == 2) if v == 2.0 else True  # who still reads the version before can


def test_self_pairs_are_made_in_as_many_parts_as_the_session_says(spark, sf_dir):
    """Small inputs of a quadratic join aren't merged into one task."""
    pairs = QUERIES["join_self_pairs"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.part for r in pairs.select(F.spark_partition_id().alias("part")).distinct().collect()} == set(range(parts))


def test_self_pairs_name_their_names_in_runs(spark, tmp_path):
    """On repeated and unplaced suppliers, null prices, and more names than a tile has, the rows are those of the SQL; what
    names take in a file is far less than a byte a row."""
    import duckdb

    from panelwright.plans import ORACLE_SQL

    rng = random.Random(9)
    names = [*range(400), 5, 70, 70]
    suppliers = [(k, None if k == 3 else 1 if k == 399 else 0) for k in rng.sample(names, len(names))]
    days = [D(1995, m, 10) for m in (1, 2, 3)]
    lines = [(k, None if rng.random() < 0.02 else float(rng.randint(1, 9999)), 1.0, d) for k in range(401) for d in days]
    for table, rows, columns in (
        ("supplier", suppliers, "s_suppkey long, s_nationkey int"), ("nation", [(0, 0), (1, 0)], "n_nationkey int, n_regionkey int"),
        ("lineitem", rng.sample(lines, len(lines)), "l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date"),
    ):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    QUERIES["join_self_pairs"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = f"'{tmp_path}/out/*.parquet'"
    want = duckdb.sql(f"SELECT a, b, date, gap FROM ({ORACLE_SQL['join_self_pairs']}) ORDER BY ALL").fetchall()
    got = duckdb.sql(f"SELECT a, b, date, gap FROM read_parquet({out}) ORDER BY ALL").fetchall()
    assert len(want) > 100_000 and [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6, nan_ok=True)
    room = duckdb.sql(f"SELECT sum(total_compressed_size) FROM parquet_metadata({out}) WHERE path_in_schema IN ('a', 'b')").fetchall()[0][0]
    assert room < 0.5 * len(want), room / len(want)
