import json

import pytest

from tidemark.sources import rules, upstream


def bodies(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "body STRING")


def test_pages_keep_their_order(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"count": 3, "results": [{"id": 5}, {"id": 4}]}))
    (tmp_path / "p2.json").write_text(json.dumps([{"id": 9, "name": ""}]))
    rows = upstream.pages(spark, str(tmp_path))
    assert [(r.page, r.ord) for r in rows.orderBy("page", "ord").collect()] == [("p1.json", 0), ("p1.json", 1), ("p2.json", 0)]
    assert {(r.group_id, r.group_name) for r in upstream.groups(rows).collect()} == {(5, "5"), (4, "4"), (9, "9")}


def test_grids_of_both_shapes_and_broken_ones(spark):
    row = {"id": 1, "tvg_id": "t", "start_time": "2026-08-03T18:00:00Z", "end_time": "2026-08-03T19:00:00Z", "title": "x"}
    found = upstream.programmes(bodies(spark, {"data": [row, {**row, "id": "dummy-custom-4-1"}]}, [row], "broken", {"other": 1}, [])).collect()
    assert len(found) == 2
    assert {(r.tvg_id, r.end_ms - r.start_ms, r.is_live) for r in found} == {("t", 3_600_000, False)}


def test_sessions_of_every_shape(spark):
    uuids = spark.createDataFrame([("ab-1", 4)], "uuid STRING, channel_id BIGINT")
    d = bodies(spark, {"count": 2, "channels": [1, "2", "ab-1", "zz-1", {"channel_id": "zz-1", "channel": "3", "m3u_profile_id": ""}, {"id": "ab-1", "m3u_profile_id": 6}, {}]}, {"channels": []}, {})
    found = sorted(map(tuple, upstream.sessions(d, uuids).collect()), key=str)
    assert found == [(1, None), (2, None), (3, None), (4, 6), (4, None)]


def test_counted_sessions_without_channels_fail(spark):
    uuids = spark.createDataFrame([], "uuid STRING, channel_id BIGINT")
    for body in ({"count": 2, "channels": ["zz-1"]}, {"count": 1, "channels": []}):
        with pytest.raises(Exception, match="none names a channel"):
            upstream.sessions(bodies(spark, body), uuids).collect()


def test_scope_and_switches(spark):
    texts = ["[3,1,3]", '["2",1]', "null", "", "[]", "bad", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    assert [r[0] for r in d.orderBy("i").select(rules.scope(d["t"])).collect()] == [[1, 3], [1, 2], None, None, None, None, None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["false", "0", "No", "OFF", "true", "1", "x", "", None])], "i INT, t STRING")
    assert [r[0] for r in d.orderBy("i").select(rules.truth(d["t"], True)).collect()] == [False] * 4 + [True] * 5


def test_empty_rules(spark):
    for doc in ({"channels": []}, {}, "broken"):
        assert rules.rules(bodies(spark, doc)).count() == 0
        assert rules.policies(bodies(spark, doc)).count() == 0
