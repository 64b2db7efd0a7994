"""Named stages: callables from a table to a table. A model goes in as a function over Arrow batches of its input table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(name: str):
    def add(function):
        if name in STAGES:
            raise ValueError(f"there is a stage {name}")
        STAGES[name] = function
        return function

    return add


def run(steps: list[tuple[str, dict]], table: DataFrame) -> DataFrame:
    """Apply named stages, one after another."""
    for name, options in steps:
        table = STAGES[name](table, **options)
    return table


def model(table: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """A model slot: ``predict`` maps an iterator of pandas frames to one of frames with ``schema``; it is loaded once for each task."""
    return table.mapInPandas(predict, schema)


def _register() -> None:
    """The library's operators from one table to one table, under their own names."""
    from ..operators import intervals, sequences, words
    from ..streaming import live

    for module, names in (
        (intervals, "merge merge_same_speaker overlap_regions overlapping_pairs close_silences sweep min_duration shifted dilate to_frames hysteresis several_active class_probability change_score stitched numbered_frames"),
        (sequences, "change_points segment_ends thin run_lengths peaks backfill turn_truth"),
        (words, "timed_words speaker_runs squashed bubbles call_words"),
        (live, "folded silences held_display"),
    ):
        for name in names.split():
            stage(name)(getattr(module, name))


_register()
