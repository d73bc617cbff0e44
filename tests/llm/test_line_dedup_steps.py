"""Steps of the line dedup that save time: packed entries, documents left out before a shuffle, copies of a row."""

import random
import numpy as np
import pyarrow as pa
import pytest
from brute import line_dedup


def test_entries_take_few_bytes():
    from kilnset.llm.line_dedup import ENTRY, _columns, _entries

    rng = np.random.default_rng(3)
    n = 3000
    for rank in (rng.integers(0, 1 << 31, n), rng.integers(-5, 5, n), np.full(n, (1 << 63) - 1)):
        e = {f: rng.integers(0, 200, n) for f in ENTRY.names} | {"rank": rank, "n": rng.integers(0, 70_000, n)}
        for f in ("key", "s0", "s1"):
            e[f] = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        e["row"] = rng.integers(-(1 << 62), 1 << 62, n)
        blobs = _columns(e, np.array([0, 10, 2000]))
        assert len(blobs) == 3 and sum(map(len, blobs)) < 0.9 * n * ENTRY.itemsize
        back = _entries(blobs)
        assert all(back[f].dtype == ENTRY[f] and (back[f] == e[f]).all() for f in ENTRY.names)
    assert all(len(x) == 0 for x in _entries([]).values())


def test_documents_are_left_out_before_texts_are_shuffled(spark):
    from kilnset.llm.line_dedup import _only, named

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    source = named(docs, "doc_id", "text")
    rows = source.where("rank % 50 = 0").select("rank", "row")
    left = {r["rank"] for r in _only(source, rows).collect()}
    assert left >= set(range(0, 3000, 50)) and len(left) < 100
    assert _only(source, rows.limit(0)).count() == 0


def test_repeated_rows_are_seen_once():
    from kilnset.llm.line_dedup import _once

    def batch(*pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["rank", "row"])

    batches = [batch((1, 1), (1, 1), (1, 2)), batch((1, 2)), batch(), batch((1, 2), (2, 2))]
    out = [tuple(r.values()) for b in _once(iter(batches)) for r in b.to_pylist()]
    assert out == [(1, 1), (1, 2), (2, 2)]


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_second_round_with_and_without_documents_left_out(spark, monkeypatch, few):
    from kilnset.llm import line_dedup as module

    monkeypatch.setattr(module, "FEW_WANTED", few)
    monkeypatch.setattr(module, "FIRST_CANDIDATES", 1)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        line = list(base)
        for _ in range(rng.randint(0, 7)):
            line[rng.randrange(30)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(line) + "\nother " + " ".join(rng.sample(base, 9)) + f" y{i}\n"))
    rows += rows[:5] + [(None, rows[0][1])] * 3 + [(200, None), (201, "")]
    out = module.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [tuple(r) for r in out.select("doc_id", "n_lines", "n_removed", "kept_text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(found, key=order) == sorted(line_dedup(rows), key=order)


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_texts_are_not_shuffled_for_prefixes(spark, monkeypatch, few):
    """What exchanges texts while it is written are the words of compared lines alone, in either round."""
    import re

    from kilnset.llm import line_dedup as module

    written = []

    class Seen(module.Scratch):
        def write(self, df):
            mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            plan = df._jdf.queryExecution().explainString(mode)
            sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
            written.append((df.columns, any(re.search(r"\btext#", x) for x in sent)))
            return super().write(df)

    monkeypatch.setattr(module, "Scratch", Seen)
    monkeypatch.setattr(module, "FEW_WANTED", few)
    monkeypatch.setattr(module, "FIRST_CANDIDATES", 1)
    rng = random.Random(9)
    rows = []
    for i in range(40):
        line = [f"w{j}" for j in range(30)]
        for _ in range(rng.randint(0, 7)):
            line[rng.randrange(30)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(line)))
    out = module.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = ["rank", "row", "line", "words"]
    assert sum(columns == sets for columns, _ in written) == 2  # there was a second round
    assert [columns for columns, sent in written if sent] == [sets, sets]
    found = [tuple(r) for r in out.select("doc_id", "n_lines", "n_removed", "kept_text").collect()]
    assert sorted(found) == sorted(line_dedup(rows))


def test_prefixes_are_read_as_written():
    from kilnset.llm.line_dedup import PERCENT, Lines, Prefixes, _entries, _leads, _prefix_entries, _prefix_lines
    from kilnset.llm.words import Words

    texts = ["b a a\n\nc d", "", None, "e e\nc d\nf"]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([5, 6, 7, 8]), pa.array(texts)], ["rank", "row", "text"])
    (made,) = _prefix_lines(np.zeros(16, np.uint64), PERCENT)(iter([rows]))
    assert made["rank"].to_pylist() == [1, 4]
    lines = Prefixes.of(Lines(Words(pa.array([t or "" for t in texts], pa.large_string())), np.zeros(16, np.uint64)), PERCENT)
    back = Prefixes.read(made, PERCENT)
    assert all((getattr(back, f) == getattr(lines, f)).all() for f in ("number", "n", "size", "parity", "word"))
    marks = [np.array(x, np.int32).tobytes() for x in ([], [2 * 1 + 1, 2 * 2])]  # an earlier document has line 1 of the last
    (left,) = _leads(PERCENT)(iter([made.append_column("marks", pa.array(marks, pa.binary()))]))
    assert [np.frombuffer(x, np.int32).tolist() for x in left["numbers"].to_pylist()] == [[0, 2], [0, 2]]
    (sent,) = _prefix_entries(PERCENT, 64)(iter([left]))
    e = _entries(sent["blob"].to_pylist())
    assert sorted(zip(e["rank"].tolist(), e["line"].tolist(), e["n"].tolist())) == [(1, 0, 2), (1, 2, 2), (4, 0, 1), (4, 2, 1)]
    assert (e["key"] < 1 << 32).all()
