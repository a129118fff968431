"""Manifests, season tables, offered lines and stitched pages on small frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.operators import lines, manifest, playbyplay
from gridspark.sources import feeds

MANIFEST = "game_id string, season int, week int, home string, away string, kickoff timestamp, event_id string, events_status string, targets array<string>, snapshot string"
EVENTS = "season int, week int, home string, away string, event_id string, starts timestamp"


def at(day, hour=18):
    return datetime.datetime(2023, 9, day, hour)


def games(spark):
    rows = [
        ("g1", 2023, 1, "A", "B", at(10), None, "pending", ["m1", "m2"], "s"), ("g2", 2023, 1, "C", "D", at(10), None, "pending", ["m1"], "s"),
        ("g3", 2023, 2, "A", "B", at(17), None, "pending", ["m1"], "s"), ("g4", 2023, 1, "E", "F", at(11), "kept", "matched", ["m1"], "s"), ("g5", None, 1, "A", "B", None, None, "pending", ["m1"], "s"),
    ]
    return spark.createDataFrame(rows, MANIFEST)


def events(spark):
    rows = [
        (2023, 1, "A", "B", "far", at(30)), (2023, 1, "A", "B", "near", at(10, 17)), (2023, 1, "A", "B", "also", at(10, 19)), (2023, 1, "A", "B", "timeless", None), (2023, 1, "A", "B", None, at(10)),
        (2023, 1, "B", "A", "turned", at(10)), (None, 1, "C", "D", "weekless", at(10)),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_events_meet_their_games_and_a_rerun_changes_nothing(spark):
    once = manifest.match_events(games(spark), events(spark))
    told = {r.game_id: (r.event_id, r.events_status) for r in once.collect()}
    assert told == {"g1": ("also", "matched"), "g2": (None, "no_match"), "g3": (None, "pending"), "g4": ("kept", "matched"), "g5": (None, "pending")}
    twice = manifest.match_events(once, events(spark))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    later = spark.createDataFrame([(2023, 2, "A", "B", "w2", None)], EVENTS)
    both = manifest.match_events(manifest.match_events(games(spark), events(spark)), later)
    assert {r.game_id: r.event_id for r in both.collect()} == {"g1": "also", "g2": None, "g3": "w2", "g4": "kept", "g5": None}
    none = manifest.match_events(once, events(spark).limit(0))
    assert sorted(map(str, none.collect())) == sorted(map(str, once.collect()))
    assert [(r.season, r.week, r.games) for r in manifest.open_weeks(once.filter("season IS NOT NULL")).collect()] == [(2023, 2, 1)]


def test_markets_and_odds_of_a_manifest(spark):
    known = manifest.match_events(games(spark), events(spark))
    seen = spark.createDataFrame([("also", "m2"), ("also", None), ("kept", "x"), (None, "m1")], "event_id string, market string")
    marked = manifest.market_status(known, seen)
    assert {r.game_id: r.markets_status for r in marked.collect()} == {"g1": "available", "g2": "missing_event", "g3": "missing_event", "g4": "no_target_markets", "g5": "missing_event"}
    odds = spark.createDataFrame([("also", "s", "m1"), ("also", "s", "m2"), ("also", "t", "m1")], "event_id string, snapshot string, market string")
    assert {r.game_id: r.odds_status for r in manifest.odds_status(marked, odds).collect()} == {"g1": "done", "g2": "missing_event", "g3": "missing_event", "g4": "no_target_markets", "g5": "missing_event"}
    half = manifest.odds_status(marked, odds.filter("market = 'm1'"))
    assert {r.game_id: r.odds_status for r in half.collect()}["g1"] == "pending"
    assert {r.markets_status for r in manifest.market_status(known, seen.limit(0)).collect()} == {"pending", "missing_event"}


def test_season_table_counts_each_side_once(spark):
    plays = spark.createDataFrame(
        [(1, "g", "A", "B", 1, 5.0), (1, "g", "A", "B", 0, None), (1, "g", "B", "A", 1, 2.0), (1, "h", "A", None, 1, 4.0), (1, None, "A", "B", 1, 9.0), (2, "g", None, "C", 1, 7.0)],
        "season int, game string, posteam string, defteam string, hit int, v double",
    )
    totals = [playbyplay.Total("v", "offence", F.col("v")), playbyplay.Total("hits", "offence", F.col("hit")), playbyplay.Total("allowed", "defence", F.col("v"))]
    out = {(r.season, r.team): r for r in playbyplay.season_table(plays, totals, [playbyplay.Share("rate", ("v",), ("hits",))], ["season"], {"offence": "posteam", "defence": "defteam"}, "game").collect()}
    a, b, c = out[1, "A"], out[1, "B"], out[2, "C"]
    assert (a.games, a.v_sum, a.hits_sum, a.allowed_sum, a.rate, a.v_mean) == (3, 9.0, 2, 2.0, 4.5, 3.0)
    assert (b.games, b.v_sum, b.allowed_sum) == (2, 2.0, 5.0) and (c.games, c.v_sum, c.rate, c.allowed_sum) == (1, None, None, 7.0)


def test_lines_say_how_they_were_matched(spark):
    game = (2023, 1, "2023_01_BUF_KC")
    offers = [
        ("a", "rec", "DK ", "Al Stone", 10.5), ("b", "rec", "dk", "Alan Stone", 20.5), ("c", "rec", "dk", "A. Reed", 5.5), ("d", "rec", "dk", "Bo Moss", 1.5), ("e", "rec", "dk", "Cy Hill", 1.5),
        ("f", "anytime_td", "dk", "Xa Ford", 0.5), ("g", "rush", "dk", "Al Stone", 3.5), ("h", "rec", "dk", "Zed", 3.5), ("i", "rec", "dk", "Bob Moss", None), ("j", "rec", "dk", "Ed Poe", 2.5), ("k", "rec", "dk", "Eve Poe", 2.5),
        ("j", "rec", "dk", "Ed Poe", 2.5),
    ]
    frame = spark.createDataFrame([(*game, m, b, n, float(x) if x else None, None, -110.0, None, t) for t, m, b, n, x in offers], "season int, week int, game_id string, market string, sportsbook string, player_name string, line double, comparable boolean, over_odds double, under_odds double, tag string")
    people = [("rec", "1", "Al Stone"), ("rec", "2", "Alan Stone"), ("rec", "3", "Abe Reed"), ("rec", "4", "Bob Moss"), ("rec", "5", "Bill Moss"), ("anytime_td", "6", "Xi Ford"), ("rec", "7", "Em Poe")]
    spots = spark.createDataFrame([(*game, m, i, n, 8.0, 9.0, 1) for m, i, n in people] + [(*game, "rec", "1", "Al Stone", 12.0, 15.0, 2)], "season int, week int, game_id string, market string, player_id string, player_name string, projection double, actual double, seen int")
    known = spark.createDataFrame([(2023, 1, "BUF", "a:stone", "al:stone", "2", "Alan S", 0.9), (2023, 1, "KC", "a:reed", "a:reed", "99", "x", 0.1)], "season int, week int, team string, name_key string, prefix_key string, player_id string, alias string, confidence double")
    prepared = lines.prepare_lines(frame)
    assert prepared.count() == 10 and prepared.select("line_id").distinct().count() == 10  # "Zed" has no key, one has no line
    out = lines.match_lines(prepared, lines.prepare_predictions(spots, "seen"), known)
    told = {(r.tag, r.match_method or r.reason, r.player_id) for r in out.collect()}
    assert told == {
        ("a", "identity_strict", "2"), ("b", "identity_strict", "2"), ("c", "initial_last_unique", "3"), ("d", "strict_prefix", "4"), ("e", "no_such_name", None), ("f", "strict_market", None),
        ("g", "no_prediction", None), ("j", "several_lines", None), ("k", "several_lines", None),
    }
    bare = lines.match_lines(prepared, lines.prepare_predictions(spots, "seen"), known.limit(0))
    assert {(r.tag, r.match_method, r.player_id, r.projection) for r in bare.collect() if r.tag in "ab"} == {("a", "strict_prefix", "1", 12.0), ("b", "strict_prefix", "1", 12.0)}
    for r in lines.join_summary(out).collect():
        parts = [r[c] for c in ("identity_strict", "strict_prefix", "initial_last_unique", "no_prediction", "no_such_name", "strict_market", "several_players", "several_lines")]
        assert sum(parts) == r.lines and sum(parts[:3]) == r.matched
    assert lines.join_summary(out.limit(0)).count() in (0, 1)


def test_market_metrics_of_a_push(spark):
    rows = spark.createDataFrame([("x", 5.0, 5.0, 7.0, None, None), ("x", 5.0, 9.0, 4.0, -110.0, 120.0), ("x", 5.0, 9.0, 5.0, 0.0, None), (None, 5.0, 9.0, 6.0, None, None)], "match_method string, line double, actual double, projection double, over_odds double, under_odds double")
    out = lines.market_metrics(rows).collect()
    assert [(r.model_pick, r.model_pick_correct, r.actual_push) for r in out] == [("over", None, True), ("under", False, False), ("push", None, False)]
    assert out[1].book_hold == pytest.approx(110 / 210 + 100 / 220 - 1) and out[0].book_hold is None and out[2].book_hold is None


def test_two_tables_of_a_page_meet_by_position(spark):
    names = "<table><tr><th>Name</th></tr><tr><td><a>Al</a></td></tr><tr><td>Bo</td></tr><tr><th>Name</th></tr><tr><td>Cy</td></tr></table>"
    values = "<table class=x><TR><th>x</th></TR><tr><th>Yds</th><th colspan='2'>TD %</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td colspan=2>4</td><td>5</td></tr></table>"
    pages = spark.createDataFrame([(1, names + "<p>" + values), (2, names), (3, None), (4, "")], "page int, html string")
    out = sorted((r.page, r.row, r.player, r.name, r.value) for r in feeds.stitched_tables(pages, "html", ["player"]).collect() if r.value is not None)
    assert out == [(1, 0, "Al", "td", "2"), (1, 0, "Al", "td_1", "3"), (1, 0, "Al", "yds", "1"), (1, 1, "Bo", "td", "4"), (1, 1, "Bo", "td_1", "5"), (1, 1, "Bo", "yds", "4")]
    lost = [r for r in feeds.stitched_tables(pages, "html", ["player"]).collect() if r.player == "Cy"]
    assert lost and all(r.value is None for r in lost)


def test_rows_with_wide_and_missing_cells(spark):
    pages = spark.createDataFrame([("<tr><td colspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><th>h</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr>",)], "html string")
    assert [tuple(r) for r in feeds.html_rows(pages, "html", ["x", "y", "z"]).collect()] == [("a", "a", "b"), ("c", None, None), ("1", "2", "3")]


def test_pages_end_where_nothing_is_new(spark):
    rows = [("f", 1, "a"), ("f", 1, "b"), ("f", 2, "b"), ("f", 2, "c"), ("f", 3, "a"), ("f", 4, "d"), ("g", 2, "x"), ("h", 1, "y")]
    out = feeds.paged(spark.createDataFrame(rows, "feed string, page int, k string"), ["feed"], "page", ["k"])
    assert sorted(map(tuple, out.collect())) == [("f", 1, "a"), ("f", 1, "b"), ("f", 2, "c"), ("h", 1, "y")]


def test_team_totals_take_the_first_table_with_a_number(spark):
    rows = [(1, "A", "Pass", "yds", "1,200", 1), (1, "A", "Pass", "yds", "5", 2), (1, "A", "pass", "td", "--", 1), (1, "A", "pass", "td", "2", 2), (1, None, "pass", "td", "2", 2), (1, "B", "pass", "td", "x", 1)]
    out = feeds.team_totals(spark.createDataFrame(rows, "season int, team string, category string, name string, value string, source int"), ["season", "team"], "category")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "A", "espn_pass_td", 2.0), (1, "A", "espn_pass_yds", 1200.0), (1, "B", "espn_pass_td", None)]


def test_statistics_in_json(spark):
    rows = [(1, "p", '{"a": 1, "b": "x", "c": null}'), (1, "p", '{"a": 3.5, "b": 2}'), (1, "p", "{"), (1, "p", None), (2, "q", "[]")]
    out = playbyplay.stat_table(spark.createDataFrame(rows, "k int, c string, s string"), ["k"], "c", "s")
    assert sorted(map(tuple, out.collect())) == [(1, "p_a", 2.25, 4.5, 2), (1, "p_b", 2.0, 2.0, 1)]


def test_records_of_lists_objects_and_nonsense(spark):
    one = '{"id": 1, "game_id": 2, "player_id": 3, "vendor": "dk", "prop_type": "x", "line_value": "1.5", "market": {"type": "m", "odds": -120}}'
    two = one.replace('"odds": -120', '"over_odds": -110, "under_odds": -105').replace('"1.5"', '"?"')
    feed = spark.createDataFrame([("a", f"[{one}]"), ("b", f'{{"data": [{two}, null]}}'), ("c", "[]"), ("d", "{}"), ("e", None), ("f", "[")], "k string, payload string")
    out = sorted((r.k, r.line, r.over_odds, r.under_odds) for r in feeds.player_prices(feed).collect() if r.id is not None)
    assert out == [("a", 1.5, -120, None), ("b", None, -110, -105)]


def test_numbered_records_leave_their_count_out(spark):
    feed = spark.createDataFrame([(1, '{"fantasy_content": {"players": {"0": {"player": [{"id": "7"}]}, "1": {}, "count": 2}}}'), (2, "{}"), (3, None)], "k int, payload string")
    assert sorted((r.k, r.position, r.id) for r in feeds.numbered(feed, "players", {"id": "$.player[0].id"}).collect()) == [(1, 0, "7"), (1, 1, None)]


def test_json_rows_have_all_fields(spark, tmp_path):
    from gridspark.sources import io

    df = spark.createDataFrame([(1, float("nan"), None, [1]), (2, 0.5, "x", None)], "a int, b double, c string, d array<int>")
    io.write_json(df, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ['{"a":1,"b":null,"c":null,"d":[1]}', '{"a":2,"b":0.5,"c":"x","d":null}']


def test_the_column_of_a_team(spark):
    from gridspark.sources import io

    df = spark.createDataFrame([(" kc ", "x")], "club string, abbr_name string")
    assert io.with_team(df).first().team == "KC" and io.first_column(df.drop("club")) is None
    with pytest.raises(ValueError, match="no column of a team"):
        io.with_team(df.drop("club"))
