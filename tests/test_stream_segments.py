"""Segments of a stream against the batch walk: in several batches, out of order, and with a restart in the middle."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatquarry.operators import blocks
from chatquarry.streaming import segments

RULE = {"gap_s": 600, "budget": 60, "most": 6, "least": 3}
LATE = 300


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Files of messages of five chats that come up to LATE seconds out of order, and the rows."""
    draw, rows, ts = random.Random(4), [], 1_000_000
    for i in range(900):
        ts += draw.choice([5, 20, 40, 700 if i % 40 == 0 else 30])
        rows.append((f"c{draw.randrange(5)}", i, ts, draw.randrange(90)))
    rows.sort(key=lambda r: r[2] + draw.randrange(LATE // 2))
    folder = tmp_path_factory.mktemp("messages")
    for k in range(6):
        part = spark.createDataFrame(rows[k * 150 : (k + 1) * 150], "chat string, doc_id long, ts long, length int").withColumn("at", F.timestamp_seconds("ts"))
        part.coalesce(1).write.parquet(str(folder / f"part={k}"))
    return folder, rows


def run(spark, files, out, state):
    schema = spark.read.parquet(files.replace("part=*", "part=0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    cut = segments.closed_segments(stream, f"{LATE} seconds", **RULE)
    query = cut.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(cut.schema).parquet(out).collect())


def wanted(spark, rows):
    """The batch segments of what the watermark has passed; of those still open, the ones whose silence it has passed."""
    passed = max(r[2] for r in rows) - LATE
    due = spark.createDataFrame([r for r in rows if r[2] < passed], "chat string, doc_id long, ts long, length int")
    last = {r[1]: r[2] for r in rows}
    out = []
    for r in blocks.segments(due, **RULE).collect():
        if r.strategy != "final":
            out.append(tuple(r))
        elif r.n >= RULE["least"] and last[r.end_doc] + RULE["gap_s"] < passed:
            out.append((*tuple(r)[:-1], "time_gap"))
    return sorted(out)


def test_stream_equals_batch_and_survives_a_restart(spark, given, tmp_path):
    folder, rows = given
    whole = run(spark, f"{folder}/part=*", str(tmp_path / "a"), str(tmp_path / "sa"))
    assert whole == wanted(spark, rows) and {"time_gap", "token_budget", "max_msgs"} == {r[5] for r in whole}
    # stopped after half of the files, started again from its state
    half = tmp_path / "half"
    half.mkdir()
    for k in range(3):
        (half / f"part={k}").symlink_to(folder / f"part={k}")
    first = run(spark, f"{half}/part=*", str(tmp_path / "b"), str(tmp_path / "sb"))
    assert 0 < len(first) < len(whole)
    for k in range(3, 6):
        (half / f"part={k}").symlink_to(folder / f"part={k}")
    assert run(spark, f"{half}/part=*", str(tmp_path / "b"), str(tmp_path / "sb")) == whole


def test_a_batch_of_messages_is_few_values_of_the_state():
    calls = []

    class State:
        def appendValue(self, value):  # noqa: N802
            calls.append([value])

        def appendList(self, values):  # noqa: N802
            calls.append(list(values))

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        getValueState = getListState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            assert at == 5001

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    cutter = segments.Segmenter(**RULE)
    cutter.init(Handle())
    batches = iter([pd.DataFrame({"ts": range(5, 10_005), "doc_id": range(10_000), "length": 1})] * 3)
    assert list(cutter.handleInputRows(("c",), batches, Handle())) == []
    assert sum(map(len, calls)) <= 3
