"""The store's commit log: writers that meet, writers that die, old versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from popspark.sources import store

NOW = datetime.datetime(2024, 1, 1)


@pytest.fixture
def pair(spark, tmp_path):
    """Two handles on one store."""
    path = str(tmp_path / "s")
    return store.ProjectStore.create(spark, path), store.ProjectStore.open(spark, path)


def messages(s):
    return [(r.ordinal, r.message) for r in s.log_entries().collect()]


def test_a_writer_that_is_overtaken_starts_again(pair, monkeypatch):
    one, two = pair
    commit, first = one._commit, []

    def late(component, version, tables):
        if not first:
            first.append(version)
            two.append_log("info", "two", NOW)
            two.append_log("info", "three", NOW)
        commit(component, version, tables)

    monkeypatch.setattr(one, "_commit", late)
    one.append_log("info", "one", NOW)
    assert messages(one) == messages(two) == [(0, "two"), (1, "three"), (2, "one")]


def test_a_replacement_and_an_append_do_not_drop_each_other(pair, spark, monkeypatch):
    one, two = pair
    id = one.add_result("r", "body", NOW)
    commit, first = one._commit, []

    def late(component, version, tables):
        if not first:
            first.append(version)
            two.attach_image(id, "b", b"2")
        commit(component, version, tables)

    monkeypatch.setattr(one, "_commit", late)
    one.attach_image(id, "a", b"1")
    one.attach_image(id, "b", b"3")
    held = {r.name: bytes(r.data) for r in two.read("results", "result_images").collect()}
    assert held == {"a": b"1", "b": b"3"} and two.results().count() == 1


class Dead(Exception):
    pass


@pytest.mark.parametrize("step", ["_folder", "_commit", "_put", "rename"])
def test_a_crash_at_any_step_changes_nothing(pair, spark, monkeypatch, step):
    one, two = pair
    one.append_log("info", "before", NOW)
    with monkeypatch.context() as m:
        if step == "rename":
            whole = one._put

            def half(path, text):  # the file is written, but not renamed
                out = one.fs.create(one._path(f"{path}.half"), False)
                out.write(bytearray(text.encode()))
                out.close()
                raise Dead

            assert whole
            m.setattr(one, "_put", half)
        else:
            real = getattr(one, step)

            def dies(*args):
                if step == "_folder":
                    real(*args)
                raise Dead

            m.setattr(one, step, dies)
        with pytest.raises(Dead):
            one.append_log("info", "lost", NOW)
    assert messages(two) == [(0, "before")]
    two.append_log("info", "after", NOW)
    assert messages(one) == [(0, "before"), (1, "after")]
    assert one.vacuum() >= (step != "_folder") and messages(two) == [(0, "before"), (1, "after")] and one.vacuum() == 0


def test_old_versions_stay_readable_and_folders_are_merged(pair, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 3)
    one, two = pair
    first = one.versions("log")[-1]
    for i in range(6):
        one.append_log("info", f"m{i}", NOW)
    assert messages(two) == [(i, f"m{i}") for i in range(6)]
    assert [two.read("log", "log_entries", v).count() for v in two.versions("log") if v >= first][:4] == [0, 1, 2, 3]
    assert len(two._entry("log")[1]["tables"]["log_entries"]) <= 3
    with pytest.raises(store.MissingComponent):
        two.read("log", "log_entries", 99)


def test_a_version_is_committed_once(pair):
    one, two = pair
    at = one.versions("graph")[-1]
    one._commit("graph", at + 1, {})
    with pytest.raises(store.Conflict):
        two._commit("graph", at + 1, {})
    names = [f.getPath().getName() for f in one.fs.listStatus(one._path(one._log("graph")))]
    assert all(n.endswith(".json") or n.endswith(".crc") for n in names)


def test_reading_tables_of_several_folders_as_views(pair):
    one, _ = pair
    for m in "ab":
        one.append_log("info", m, NOW)
    assert one.sql("select count(*) as n from log_entries where log_type = :t", t="info").first().n == 2
    assert one.read("log", "log_entries").select(F.max("ordinal")).first()[0] == 1
