"""Caches of the driver and export files."""

import json

from tidemark.sources import exports, rules
from tidemark.sources.cached import TimedTable, WatchedFile


def test_timed_table(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        return spark.range(0 if now[0] == 20 else len(loads))

    t = TimedTable(load, 10, lambda: now[0])
    assert [t.get().count(), t.get().count()] == [1, 1] and loads == [0.0]
    now[0] = 10
    assert t.get().count() == 2 and not t.stale and t.get(force=True).count() == 3
    now[0] = 20
    assert t.get().count() == 3 and t.stale  # an empty answer leaves what was there
    now[0] = 29
    assert t.get().count() == 3 and len(loads) == 4


def test_watched_file(spark, tmp_path):
    at = tmp_path / "rules.json"
    body = lambda *ids: json.dumps({"channels": [{"channel_id": i, "aliases": ["a"]} for i in ids]})
    at.write_text(body(1))
    made = []
    w = WatchedFile(spark, f"file://{at}", lambda bodies: made.append(1) or rules.rules(bodies))
    assert [r.channel_id for r in w.get().collect()] == [1] and w.get() is w.get() and len(made) == 1
    at.write_text(body(1, 22))
    assert sorted(r.channel_id for r in w.get().collect()) == [1, 22] and len(made) == 2


def test_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"channel_id": 1, "name": "x", "aliases": ["X"]}]))
    (tmp_path / "b.json").write_text(json.dumps({"channels": [{"channel_id": 2, "enabled": False}, {"name": "no id"}]}))
    found = {(r.channel_id, r.enabled, tuple(r.aliases), tuple(r.contains)) for r in exports.read_export(spark, f"file://{tmp_path}").collect()}
    assert found == {(1, True, ("X",), ()), (2, False, (), ())}
