"""Streams on state processors: timers, order, restarts from a checkpoint, and the message source, each against its batch form."""

import base64
import json
import os
import random

import numpy as np
import pytest

from parley.sources import live_source
from parley.streaming import evaluation, live, ordered

ROWS = "session long, ord long, s double, e double, spk string, speech boolean, reset boolean, confidence double"
T0 = 1_700_000_000.0


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def chunks(n=90):
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(n):
        t += rng.choice([0.5, 0.5, 1.0, 4.0, 40.0 if i % 30 == 29 else 0.25])
        rows.append((i % 3, i, t, t + rng.choice([0.25, 0.5, 1.0]), rng.choice(["A", "B", None]), rng.random() < 0.6, i % 41 == 40, rng.random()))
    return rows


def run(stream, path):
    query = stream.writeStream.format("parquet").option("path", f"file://{path}/out").option("checkpointLocation", f"file://{path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


RULES = [(live.Buffer, {"most": 3.0, "fresh": 1.0, "interval": 1.5}), (live.Microbatch, {}), (live.Display, {"hold": 1.5})]


@pytest.mark.parametrize("rule, options", RULES)
def test_timers_fire_and_a_restart_changes_nothing(spark, tmp_path, rule, options):
    rows = chunks()
    rng = random.Random(5)
    want = ordered.folded_in_time(spark.createDataFrame(rows, ROWS), rule, idle=30.0, reset="reset", **options).collect()
    assert any(r["ord"] is None for r in want), "nothing is due between rows"
    # rows of a micro-batch in any order; a last row of another session moves the watermark past all wakes
    parts = [rows[:30], rows[30:60], rows[60:], [(9, 10_000, T0 + 10_000, T0 + 10_000, None, False, False, 0.0)]]
    source = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    for k, part in enumerate(parts):
        spark.createDataFrame(rng.sample(part, len(part)), ROWS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        if k in (1, 3):  # stops and starts again from the checkpoint
            run(ordered.streamed_in_time(source(), rule, late="5 seconds", idle=30.0, reset="reset", **options), tmp_path)
    got = spark.read.parquet(f"file://{tmp_path}/out").where("session <> 9").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_wakes_of_a_plain_loop(spark):
    """The buffer's wakes by hand: half a second of sound each 0.4 s, then nothing more."""
    rows = [(1, i, 0.4 * i, 0.4 * i + 0.5, "A", True, False, 1.0) for i in range(6)]
    got = ordered.folded_in_time(spark.createDataFrame(rows, ROWS), live.Buffer, fresh=1.0, interval=1.0).orderBy("t").collect()
    assert [(r["ord"], round(r["t"], 6)) for r in got if r["due"]] == [(1, 0.4), (None, 1.4), (None, 2.4)]
    assert [r["length"] for r in got if r["ord"] is None] == [2.0, 3.0] and len(got) == 8


def test_display_clears_by_itself(spark):
    rows = [(1, 0, 0.0, 0.5, "A", True, False, 1.0), (1, 1, 1.0, 1.5, None, False, False, 0.0), (1, 2, 60.0, 60.5, "B", True, False, 1.0), (1, 3, 61.0, 61.5, None, False, False, 0.0), (1, 4, 61.5, 62.0, None, True, False, 0.0)]
    got = ordered.folded_in_time(spark.createDataFrame(rows, ROWS), live.Display, hold=1.5).orderBy("t").collect()
    assert [(r["ord"], r["t"], r["shown"]) for r in got] == [(0, 0.0, "A"), (1, 1.0, "A"), (None, 2.5, None), (2, 60.0, "B"), (3, 61.0, "B"), (4, 61.5, None)]


def message(path, number, rate=4, session="x", seconds=1.0, at=None, **more):
    sound = np.arange(int(rate * seconds), dtype="<f4")
    body = {"audio_data": base64.b64encode(sound.tobytes()).decode(), "sample_rate": str(rate), "session_id": session} | more
    body = {k: v for k, v in body.items() if v is not None}
    tmp = path / f".{number}.tmp"
    tmp.write_text(json.dumps(body))
    os.utime(tmp, (at or number, at or number))
    tmp.rename(path / f"{number}.json")


def test_message_source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    live_source.register(spark)
    message(folder, 100, session=None)
    message(folder, 101, time=T0)
    damaged = ["{", "[1]", json.dumps({"session_id": "y"}), json.dumps({"audio_data": "AAAA", "sample_rate": 4}), json.dumps({"audio_data": "?", "sample_rate": 4}), json.dumps({"audio_data": "AAAAAA==", "sample_rate": 0}), json.dumps({"audio_data": "", "sample_rate": 8})]
    (folder / "102.json").write_text("\n".join(damaged) + "\n\n")
    (folder / "103.part").write_text("{}")
    (folder / "notes.json").write_text("{}")
    rows = spark.read.format("chunk_messages").load(f"file://{folder}").orderBy("ord").collect()
    assert [(r["session"], r["error"]) for r in rows] == [("default", None), ("x", None), ("default", "not JSON"), ("default", "not an object"), ("y", "no audio_data"), ("default", "audio_data is not whole float32 samples"), ("default", "audio_data is not base64"), ("default", "sample_rate is not a positive whole number"), ("default", None)]
    assert (rows[0]["s"], rows[0]["e"], rows[0]["samples"]) == (100.0, 101.0, [0.0, 1.0, 2.0, 3.0]) and (rows[1]["s"], rows[8]["samples"]) == (T0, [])
    assert spark.read.format("chunk_messages").load(f"file://{tmp_path}/nowhere").count() == 0


@pytest.mark.parametrize("form", ["arrival", "time"])
def test_messages_are_folded_once_over_a_restart(spark, tmp_path, form):
    folder = tmp_path / "in"
    folder.mkdir()
    live_source.register(spark)
    source = lambda: spark.readStream.format("chunk_messages").option("numPartitions", 3).load(f"file://{folder}").where("error is null").drop("samples")
    fold = lambda: ordered.streamed_on_arrival(source(), live.Accumulation, need=2.0) if form == "arrival" else ordered.streamed_in_time(source(), live.Accumulation, late="1 seconds", need=2.0)
    for number in range(1000, 1030):
        message(folder, number, session="ab"[number % 2], seconds=0.25 * (1 + number % 4), **({"audio_data": None} if number == 1007 else {}))
        if number in (1010, 1021):
            run(fold(), tmp_path)
    for number in (9000, 9001):  # a batch, and one that comes after the watermark has moved past all others
        message(folder, number, session="end")
        run(fold(), tmp_path)
    run(fold(), tmp_path)  # nothing new
    got = spark.read.parquet(f"file://{tmp_path}/out").where("session <> 'end'")
    names = ["session", "ord", "held", "ready"]
    want = live.folded(spark.read.format("chunk_messages").load(f"file://{folder}").where("error is null and session <> 'end'").drop("samples"), live.Accumulation, need=2.0)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect())) and got.count() == 29


def plain_rates(rows):
    """The rates of one file's (chunk, has_speech, transcript) rows."""
    import re

    plain = lambda t: re.sub(r"^\W+|\W+$", "", t.lower())
    snippets = [(t or "").strip() for *_, t in sorted(rows, key=lambda r: r[0])]
    snippets = [t for t in snippets if t]
    raw = " ".join(snippets).split()
    toks = [p for t in raw if (p := plain(t))]
    grams = [tuple(toks[i : i + 3]) for i in range(len(toks) - 2)]
    return (
        len(rows), sum(bool(r[1]) for r in rows) / max(1, len(rows)), len(toks), sum(a == b for a, b in zip(toks, toks[1:])) / (len(toks) - 1) if len(toks) > 1 else 0.0,
        (len(grams) - len(set(grams))) / len(grams) if len(toks) >= 6 else 0.0, sum("..." in t for t in raw) / max(1, len(raw)), sum(len([p for t in s.split() if (p := plain(t))]) <= 2 for s in snippets) / max(1, len(snippets)),
    )


def test_stream_evaluation_is_idempotent(spark, tmp_path):
    rng = random.Random(2)
    texts = ["so so it goes ...", "no", None, "  ", "a b c a b c a b c", "Well, well... then", "- ?", "it goes on"]
    rows = [(f"f{i % 4}", i // 4, rng.choice([True, False, None]), rng.choice(texts)) for i in range(60)] + [("silent", 0, None, None)]
    parts = [rows[:25], [*rows[25:45], rows[3]], rows[45:]]  # one response is sent again
    for k, part in enumerate(parts):
        spark.createDataFrame(part, evaluation.RESPONSES).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(evaluation.RESPONSES).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    folder = f"file://{tmp_path}/rates"
    for _ in range(2):  # the second run has nothing new
        query = evaluation.evaluate(stream(), folder, f"file://{tmp_path}/cp")
        assert query.awaitTermination(120) and query.exception() is None
    assert sorted(p.name for p in (tmp_path / "rates").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    names = ["responses", "has_speech_rate", "total_words", "adj_dup_rate", "trigram_repeat_rate", "ellipsis_token_rate", "short_snippet_rate"]
    rates = lambda: {r["file"]: tuple(r[n] for n in names) for r in evaluation.response_rates(evaluation.stored(spark, folder)).collect()}
    want = {f: pytest.approx(plain_rates([r[1:] for r in rows if r[0] == f])) for f in {r[0] for r in rows}}
    assert rates() == want
    again = spark.read.schema(evaluation.RESPONSES).parquet(f"{folder}/batch=1")
    evaluation.store_batch(spark.createDataFrame(again.collect(), evaluation.RESPONSES), 1, folder)  # an attempt after a lost commit
    assert rates() == want
    mean = evaluation.summary(evaluation.response_rates(evaluation.stored(spark, folder))).first()
    assert mean["n"] == 5 and mean["avg_has_speech_rate"] == pytest.approx(np.mean([plain_rates([r[1:] for r in rows if r[0] == f])[1] for f in want]))
    assert evaluation.summary(evaluation.response_rates(spark.createDataFrame([], evaluation.RESPONSES))).first()["avg_adj_dup_rate"] == 0.0
