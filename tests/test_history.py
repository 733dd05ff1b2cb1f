"""Dated snapshots: once a day, kept for a while, never compared when stale."""

import pytest

from ledgerloom.sources.history import DAY, HOUR, History, changes

NOW = 1_700_000_000


@pytest.fixture
def scores(spark):
    return lambda *values: spark.createDataFrame(list(enumerate(values)), "avatar long, score long")


def test_once_a_day_and_expiry(spark, tmp_path, scores):
    h = History(spark, str(tmp_path / "h"))
    assert h.times() == [] and h.expire(NOW) == [] and h.before(NOW, DAY) is None
    assert h.add(scores(1, 2), NOW) and not h.add(scores(9, 9), NOW) and not h.add(scores(9), NOW + 22 * HOUR)
    assert h.add(scores(3, 4), NOW + 23 * HOUR) and h.times() == [NOW, NOW + 23 * HOUR]
    assert sorted(tuple(r) for r in h.read(NOW).collect()) == [(0, 1, NOW), (1, 2, NOW)]
    assert h.expire(NOW + 90 * DAY) == [] and h.expire(NOW + 90 * DAY + 1) == [NOW] and h.times() == [NOW + 23 * HOUR]


def test_a_snapshot_that_broke_off_is_written_anew(spark, tmp_path, scores):
    h = History(spark, str(tmp_path / "h"))
    h.add(scores(1), NOW)
    (tmp_path / "h" / f"taken={NOW}" / "_SUCCESS").unlink()
    assert h.times() == [] and h.add(scores(5), NOW) and h.read(NOW).first().score == 5


def test_changes_against_the_newest_old_enough(spark, tmp_path, scores):
    h = History(spark, str(tmp_path / "h"))
    old = NOW - 8 * DAY
    h.add(scores(50, 50, 50, 50, 50), old)
    h.add(scores(60, 60, 60, 60, 60), NOW - 30 * HOUR)
    current = scores(40, 39, 90, 91, 60, 7)
    got = lambda window, at=NOW: tuple(changes(h, current, "avatar", "score", at, window).first())
    assert got(DAY) == (5, 1, 1, 2, 2), "more than 20 down, more than 30 up; who wasn't there isn't compared"
    assert got(7 * DAY) == (5, 0, 2, 2, 3)
    assert got(9 * DAY) == (0, 0, 0, 0, 0)
    assert h.before(NOW + 18 * HOUR, DAY) == NOW - 30 * HOUR and h.before(NOW + 18 * HOUR + 1, DAY) is None, "a stale history gives none"
    assert h.before(NOW - 30 * HOUR, DAY) is None
