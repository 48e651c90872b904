import os

import pyarrow as pa

from orbweave.llm import common as C


def test_one_operator_keeps_one_thing():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    C.forget()
    assert C.keep("a", (1,), make("x")) == "x" and C.keep("a", (1,), make("y")) == "x"
    C.forget("a")
    assert C.keep("a", (1,), make("y")) == "x"
    assert C.keep("a", (2,), make("z")) == "z"
    assert C.keep("b", (2,), make("w")) == "w" and made == ["x", "z", "w"]
    C.forget("a")
    assert C.keep("b", (2,), make("v")) == "v"


def test_a_task_drops_what_another_operator_kept(spark):
    """Workers are used again, so a process's second task sees what its first kept."""

    def first(batch):
        C.keep("a", (), object)
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([True] * batch.num_rows)], ["pid", "kept"])

    def later(batch):
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows), pa.array([bool(C._kept)] * batch.num_rows)], ["pid", "kept"])

    rows = spark.createDataFrame([(str(i),) for i in range(64)], "text string").repartition(8).cache()
    run = lambda fn, owner: {tuple(r) for r in C.map_chunks(rows, fn, "pid long, kept boolean", owner=owner).collect()}
    used = {pid for pid, _ in run(first, "a")}
    again = run(later, "a")
    assert any(pid in used for pid, _ in again) and all(kept == (pid in used) for pid, kept in again)
    assert not any(kept for _, kept in run(later, "b"))
