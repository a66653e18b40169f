"""Requests for profiles and series, in their order."""

from siltstone.operators import profiles


def test_profiles_by_name_seed_fallback_and_first(spark):
    own = spark.createDataFrame([("north-asia", "North Asia AI", 2), ("global-risk-regime", "Global Risk", 3), ("", "Energy Desk", 1), ("energy-desk", "Other", 4)], "id string, title string, seq int")
    asked = [("a", " North Asia AI", "x"), ("b", None, "global risk"), ("c", "unknown", "Énergy desk"), ("d", "", None), ("e", "energy-desk", "north-asia"), (None, "NORTH_asia", "")]
    requests = spark.createDataFrame(asked, "request string, profile string, seed string")
    got = {r.request: r.profile for r in profiles.resolved_profiles(requests, own).collect()}
    assert got == {"a": "north-asia", "b": "global-risk-regime", "c": "global-risk-regime", "d": "global-risk-regime", "e": "energy-desk", None: "north-asia"}
    got = {r.request: r.profile for r in profiles.resolved_profiles(requests, own.where("id <> 'global-risk-regime'")).collect()}
    assert got["d"] == "energy-desk"
    assert profiles.resolved_profiles(requests.limit(0), own).count() == 0


def test_series_keep_the_requested_order(spark):
    catalog = spark.createDataFrame([("SPX", 2), ("gold", 1), ("oil", 3), ("Gold", 9)], "series_id string, seq int")
    own = spark.createDataFrame([("p", ["oil", "gold"]), ("q", None)], "id string, series array<string>")
    asked = [(1, "p", ["spx ", "nothing", "OIL", "spx"]), (2, "p", []), (3, "q", [" "]), (4, None, None), (5, "p", ["no"])]
    requests = spark.createDataFrame(asked, "request int, profile string, series array<string>")
    rows = profiles.resolved_series(requests, own, catalog)
    got = {}
    for r in rows.orderBy("request", "place").collect():
        got.setdefault(r.request, []).append(r.series)
    assert got == {1: ["SPX", "oil", "SPX"], 2: ["oil", "gold"], 3: ["gold", "SPX", "oil"], 4: ["gold", "SPX", "oil"]}
    stats = spark.createDataFrame([("SPX", 0.0123, -0.5, 0.25, float("nan"), 1.0), ("oil", 0.0, 0.0, 1.0, -0.1, 0.1)], "series string, mean double, median double, p_up double, p10 double, p90 double")
    tables = {r.request: r.table.split("\n") for r in profiles.horizon_tables(rows, stats).collect()}
    assert tables[1][2:] == ["| SPX | 1.2% | -50.0% | 25.0% | n/a | 100.0% |", "| oil | 0.0% | 0.0% | 100.0% | -10.0% | 10.0% |", "| SPX | 1.2% | -50.0% | 25.0% | n/a | 100.0% |"]
    none = profiles.horizon_tables(rows.where("series = 'gold'"), stats).first().table
    assert none.split("\n")[2:] == [profiles.NO_SERIES]


def test_ranked_lines(spark):
    df = spark.createDataFrame([("m", "b", 0.25), ("m", "a", 0.25), ("m", "c", 0.5)], "by string, label string, probability double")
    assert profiles.ranked_lines(df, "by").first().lines == "- c: 50.0%\n- a: 25.0%\n- b: 25.0%"
