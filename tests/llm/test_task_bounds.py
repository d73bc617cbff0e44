"""What tasks of the text operators hold and send."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from kilnset.llm import repeats, substring_dedup


def _texts(size):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=600)) for _ in range(size // 3600)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()),
                                       pa.array(texts, pa.string())], ["rank", "row", "text"])


def test_windows_of_a_task_are_held_slice_by_slice():
    batch = _texts(8 << 20)
    tracemalloc.start()
    for _ in substring_dedup._first_level(7, 64)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20  # 71 MB with slices of 4 MB and all counts per window


def test_items_that_differ_in_low_bits_only():
    # equal in all bits that are sorted on, and in no order
    base = np.uint64(0xABCDEF0123456700)
    keys = base + np.array([3, 1, 3, 2, 1, 7, 3], dtype=np.uint64)
    doc = np.array([0, 0, 1, 1, 2, 2, 2])
    pos = np.arange(len(keys))
    rank = row = np.array([10, 20, 30])
    entries = pa.Table.from_batches([repeats.emit(keys, doc, pos, rank, row, 64)])
    found = set()
    for bucket in set(entries["bucket"].to_pylist()):
        mask = pa.array([b == bucket for b in entries["bucket"].to_pylist()])
        marks = repeats.judge(entries.filter(mask))
        for k, cell in zip(marks["rank"].to_pylist(), marks["marks"].to_pylist()):
            found |= {(k, m >> 1, m & 1) for m in np.frombuffer(cell, np.int32).tolist()}
    assert found == {(10, 0, 0), (20, 2, 1), (30, 6, 1), (10, 1, 0), (30, 4, 1)}


def test_naming_frequent_words_leaves_the_slices_in_place(spark, monkeypatch):
    from kilnset.llm.collocations import phrases
    from kilnset.llm.scratch import Scratch

    plans, write = [], Scratch.write

    def seen(self, df):
        if "heads" in df.columns and "a" not in df.columns:  # the names of words
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", seen)
    rows = [("en", f"one two three {k % 3}") for k in range(40)] + [(None, "one two, two one")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for asked words beyond it
    try:
        found = {(r.lang, " ".join(r.words)): r.a for r in phrases(docs, least=9).collect()}
        far = {(r.lang, " ".join(r.words)): r.a for r in phrases(docs, least=9, few=1).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == far and found["en", "one two three"] == 40 and found["und", "two one"] == 9
    assert "slice" in plans[0] and "BroadcastHashJoin [slice" in plans[0]
    assert "SortMergeJoin [slice" in plans[1]


def test_lines_that_are_gone_are_not_sorted():
    from kilnset.llm.line_dedup import Lines
    from kilnset.llm.words import Words

    column = pa.array(["b a a\n\nc d", "", "e e\nc d\nf"], pa.large_string())
    lines = Lines(Words(column), gone=np.array([2, 2 << 32 | 1]))
    assert list(zip(lines.doc.tolist(), lines.number.tolist(), lines.n.tolist())) == [(0, 0, 2), (2, 0, 1), (2, 2, 1)]
