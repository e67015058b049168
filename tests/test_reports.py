"""Entry point, reports, command line and the file stream."""

import json

import __spark_entry__
from metaladder import cli
from metaladder.plans import registry
from metaladder.plans import report as reports
from metaladder.streaming.follow import follow
from metaladder.tables import Tables

from .test_domain import event  # noqa: F401


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_report_files(spark, event, tmp_path):  # noqa: F811
    event.write(str(tmp_path / "tables"))
    again = Tables.read(spark, str(tmp_path / "tables"))
    assert again.matches.count() == event.matches.count() > 0
    cli.main(["--tables", str(tmp_path / "tables"), "report", "--since", "2026-01-01", "--out", str(tmp_path / "out"), "--bootstrap", "2", "--scope", "all"], spark)
    for scope in ("online", "paper", "combined"):
        text = (tmp_path / "out" / scope / "README.md").read_text()
        assert "| archetype |" in text
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "combined" / "archetypes.csv"))
    names = {r.archetype for r in event.decks.collect()}
    assert {r.archetype for r in table.collect()} == names
    known = max(names - {"Unknown"}, key=lambda n: event.decks.filter(event.decks.archetype == n).count())
    try:
        reports.card_report(again, known[:-1].lower(), str(tmp_path / "cards"))
        raise AssertionError
    except ValueError as error:
        assert known in str(error)
    assert "delta" in reports.card_report(again, known, str(tmp_path / "cards"), min_decks=1).columns


def test_formats():
    assert reports.points(-0.0001) == "+0.0" and reports.points(0.0123) == "+1.2" and reports.percent(None) == ""
    assert "</" not in reports.embedded({"a": "</script>"})


def test_payload_names_no_player(event):  # noqa: F811
    data = reports.payload(event, periods=(300,), bootstrap=2)
    assert data["methods"]["bootstrap"] == 2 and data["scopes"]["combined"] is None
    assert set(data["cells"]) == {"300/online", "300/paper", "300/combined"}
    cell = data["cells"]["300/combined"]
    assert {r["archetype"] for r in cell["summary"]} <= {r.archetype for r in event.decks.collect()} and cell["summary"]
    assert '"player' not in json.dumps(data)


def test_stream_appends_new_events_once(spark, tmp_path):
    day = tmp_path / "in" / "Tournaments" / "MTGO" / "2026"
    day.mkdir(parents=True)
    put = lambda name, uri: (day / name).write_text(json.dumps({"Tournament": {"Date": "2026-01-02", "Name": "League", "Uri": uri, "Formats": "legacy"}, "Decks": [], "Standings": [{"Player": "x"}]}))
    put("a.json", "u1")
    put("b.json", "u1")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "Legacy")
    follow(*args)
    put("c.json", "u1")
    put("d.json", "u2")
    follow(*args)
    assert sorted((r.uri, r.event_type, r.players) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("u1", "league", 1), ("u2", "league", 1)]
