"""Keyed state of a stream of notices against the differences of whole tables."""

from datetime import datetime

from lodestrata.streaming import changes

DAY = "2024-01-0"


def notice(path, content, day, hour=0):
    return (path, content, datetime(2024, 1, day, hour))


def run(spark, tmp_path, waves, ttl=None, late="1 hour"):
    for wave in waves:
        spark.createDataFrame(wave, changes.NOTICE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", ttl, late).awaitTermination()
    rows = spark.read.schema(changes.CHANGE + ", batch long").parquet(f"{tmp_path}/out").collect()
    return sorted((r["batch"], r["source_path"], r["change"], r["content_hash"]) for r in rows)


def test_changes_by_notice(spark, tmp_path):
    waves = [
        [notice("a", "1", 1), notice("b", "1", 1), notice("c", "1", 1), notice("d", None, 1), (None, "x", datetime(2024, 1, 1)), ("e", "x", None)],
        [notice("a", "1", 2), notice("b", "2", 2), notice("c", None, 2)],
        [notice("a", None, 3), notice("a", "9", 2, 12), notice("c", "1", 3), notice("b", "0", 1, 12)],  # two of a, and one of b that is late
        [notice("a", "9", 4), notice("c", "1", 4)],
    ]
    before = spark.conf.get(changes.PROVIDER, None)
    got = run(spark, tmp_path, waves, late="10 days")
    assert spark.conf.get(changes.PROVIDER, None) == before
    by = {}
    for _, path, change, content in got:
        by.setdefault(path, []).append((change, content))
    assert by == {
        "a": [("added", "1"), ("unchanged", "1"), ("tombstoned", "9"), ("reactivated", "9")], "b": [("added", "1"), ("updated", "2")], "c": [("added", "1"), ("tombstoned", "1"), ("reactivated", "1"), ("unchanged", "1")],
    }
    state = {r["source_path"]: (r["change"], r["active"]) for r in changes.present(spark, f"{tmp_path}/out").collect()}
    assert state == {"a": ("reactivated", True), "b": ("updated", True), "c": ("unchanged", True)}


def test_paths_not_seen_again_are_tombstoned(spark, tmp_path):
    waves = [[notice("a", "1", 1), notice("b", "1", 1)], [notice("a", "1", 3)], [notice("tick", "1", 3, 12)], [notice("b", "1", 4), notice("a", "1", 4)]]
    got = [g[1:] for g in run(spark, tmp_path, waves, ttl="1 day")]
    assert ("b", "tombstoned", "1") in got and ("b", "reactivated", "1") in got and got.count(("a", "unchanged", "1")) == 2
    assert ("a", "tombstoned", "1") not in got  # its timer was put off by the second notice


def test_a_path_makes_no_frame_and_lists_no_timers():
    import inspect

    source = inspect.getsource(changes)
    assert "transformWithStateInPandas" not in source and "listTimers" not in source


def test_each_active_path_has_one_timer():
    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        def getValueState(self, name, schema):  # noqa: N802
            return self.value

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    state, handle = changes.PathState(10), Handle()
    state.init(handle)
    say = lambda content_hash, ms: [r["change"] for r in state.handleInputRows(("p",), iter([{"content_hash": content_hash, "ms": ms}]), None)]
    assert say("a", 5) == ["added"] and handle.timers == [15]
    assert say("a", 7) == ["unchanged"] and handle.timers == [17]
    assert say("b", 7) == ["updated"] and handle.timers == [17]
    assert say("c", 6) == [] and handle.timers == [17]
    assert say(None, 8) == ["tombstoned"] and handle.timers == []
    assert say("b", 9) == ["reactivated"] and handle.timers == [19]
