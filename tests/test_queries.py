"""Every registered query beside its SQL, with cells as measured and with narrow ones."""

import pytest

from compare import compare
from streamlens.functions.media import MICROS
from streamlens.operators import layout
from streamlens.plans import event_tables
from streamlens.plans.oracle import ORACLE
from streamlens.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
# What cells are made of does not matter for results; one day and a bit cuts each stream up.
NARROW = 100_000
CELLED = [
    "frames_base", "route_media", "route_media_by_index", "name_frames", "sample_at_times",
    "command_outcome", "sessions", "record_sessions", "recording_task", "recording_rates", "record_methods",
    "recording_methods_task", "gap_sessions",
    "until_timeout", "interleave", "screenshot_responses", "recording_responses",
    "active_task_profile", "layout_diff", "layout_replay", "mix_task", "mix_on_clock",
    "mix_responses",
]


def test_every_query_has_sql():
    assert set(all_queries()) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    compare(all_queries()[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", CELLED)
def test_query_equals_sql_over_many_cells(spark, name, monkeypatch):
    monkeypatch.setattr(event_tables, "cell_seconds", lambda spark, sf: NARROW)
    monkeypatch.setattr("streamlens.plans.registry.measure_cell_seconds", lambda *a: 7_200)
    for fn, width in ((layout.layout_diff, 2), (layout.layout_replay, 2)):
        monkeypatch.setattr(fn, "__defaults__", (width,))
    monkeypatch.setattr(layout.mix_on_clock, "__defaults__", (None, MICROS, 2))
    compare(all_queries()[name](spark, SF), ORACLE[name], SF)
