"""Operators on texts against plain loops, on rows of every odd kind."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import base_counts, jaccard_components, line_dedup, substring_dedup, weak_votes, words
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnset.llm.words import Words, as_strings, window_hashes

key = lambda r: tuple((x is None, x) for x in r)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\r\x0b\x0cé 字", max_size=30)), max_size=8))
def test_words_are_the_pattern(texts):
    found = Words(as_strings(pa.array(texts, pa.string())))
    expected = [w.encode() for t in texts for w in words(t)]
    data = found.data.tobytes()
    assert [data[a:b] for a, b in zip(found.start, found.end)] == expected
    assert found.n.tolist() == [len(words(t)) for t in texts]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(expected))


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 13, 16])
def test_windows_hash_their_words(width):
    rng = np.random.default_rng(1)
    items = rng.integers(0, 3, 400).astype(np.uint64) + np.uint64(9)
    found = window_hashes(items, width)
    expected = [tuple(items[p:p + width]) for p in range(len(items) - width + 1)]
    assert len(found) == len(expected)
    assert len(set(zip(found.tolist(), expected))) == len(set(expected)) == len(set(found.tolist()))


def test_substring_dedup(odd_docs, odd_texts):
    from kilnset.llm.substring_dedup import substring_dedup as run

    found = [tuple(r) for r in run(odd_docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat").collect()]
    assert sorted(found, key=key) == sorted(substring_dedup(odd_texts), key=key)
    texts = run(odd_docs, with_text=True).select("kept_text", "kept_sha256").collect()
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for t, h in texts)


def test_jaccard_components(odd_docs, odd_texts):
    from kilnset.llm.jaccard_join import jaccard_components as run

    found = [tuple(r) for r in run(odd_docs).collect()]
    assert sorted(found, key=key) == sorted(jaccard_components(odd_texts), key=key)


def test_jaccard_blocks(spark, monkeypatch):
    """A group of different near copies that no single leader settles."""
    import random

    from kilnset.llm import jaccard_join

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        start = rng.randrange(100)
        for p in range(start, start + rng.choice([2, 6, 10, 14])):
            w[p] = f"x{rng.randrange(6)}{p}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    found = [tuple(r) for r in jaccard_join.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(jaccard_components(rows))


def test_line_dedup(odd_docs, odd_texts):
    from kilnset.llm.line_dedup import dedup_lines

    out = dedup_lines(odd_docs).select("doc_id", "n_lines", "n_removed", "kept_text", "kept_sha256").collect()
    assert sorted([tuple(r)[:4] for r in out], key=key) == sorted(line_dedup(odd_texts), key=key)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_line_dedup_long_lists_and_second_round(spark, monkeypatch):
    from kilnset.llm import line_dedup as module

    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(3):
            w = list(base)
            for p in rng.sample(range(30), rng.choice([1, 2, 3, 4])):
                w[p] = f"y{rng.randrange(40)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    monkeypatch.setattr(module, "LIST_BLOCK", 6)
    monkeypatch.setattr(module, "FIRST_CANDIDATES", 1)
    out = module.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [tuple(r) for r in out.select("doc_id", "n_lines", "n_removed", "kept_text").collect()]
    assert sorted(found) == sorted(line_dedup(rows))


def test_quality_rules(spark, odd_docs, odd_texts):
    from kilnset.llm.quality_rules import fit_quality, quality_rules

    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    out = quality_rules(odd_docs, fit_quality(odd_docs, labels), carry=("rank", "kept"))
    assert out.columns[:1] == ["doc_id"] and out.columns[-2:] != ["rank", "kept"]
    plain = quality_rules(odd_docs, fit_quality(odd_docs, labels))
    found = [tuple(r)[:6] for r in plain.collect()]
    assert sorted(found, key=key) == sorted([(i, *base_counts(t)) for i, t in odd_texts], key=key)
    for r in plain.collect():
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # one class only: no verdict


def test_trained_verdicts_on_held_out_rows(spark):
    """Both classifiers tell labelled rows apart that they were not fitted on."""
    from kilnset.llm.quality_rules import fit_quality, quality_rules
    from kilnset.llm.weak_labels import classify

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").withColumnRenamed("quality", "label")
    judged = quality_rules(docs, fit_quality(docs, half)).where("not base_failed").join(rest, "doc_id").toPandas()
    right = (judged.kept == (judged.label == 1)).groupby(judged.label).mean()
    assert right[1] > 0.99 and right[0] > 0.95, right
    bins = judged.groupby(judged.quality > 0.5).apply(lambda g: abs(g.quality.mean() - g.label.mean()), include_groups=False)
    assert bins.max() < 0.1  # calibrated
    weak = classify(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").toPandas()
    right = (weak.kept == (weak.label == 1)).groupby(weak.label).mean()
    assert right[1] > 0.99 and right[0] > 0.8, right


def test_weak_label_estimates():
    """EM finds the accuracies that votes were drawn with."""
    from kilnset.llm.weak_labels import ABSTAIN, estimate

    rng = np.random.default_rng(4)
    n, accuracy = 20000, np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    good = rng.random(n) < 0.7
    right = rng.random((n, 5)) < accuracy
    votes = np.where(right == good[:, None], 2, 1)
    votes[rng.random((n, 5)) < 0.3] = ABSTAIN
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table, share = estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.02
    assert np.abs(table[1, :, 2] / table[1, :, 1:].sum(axis=1) - accuracy).max() < 0.03
    assert ((posterior[inverse.ravel()] > 0.5) == good).mean() > 0.93


def test_weak_labels_on_odd_rows(spark, odd_docs, odd_texts):
    from kilnset.llm.weak_labels import LABELLERS, classify

    out = classify(odd_docs)
    more = [(1000 + i, "# " * i + "Some words. " * (40 - i) + "!" * (i % 9) + "ABC DEF " * (i % 13)) for i in range(40)]
    every = spark.createDataFrame([*odd_texts, *more], "doc_id long, text string")
    names = ["doc_id", *[f"vote_{x}" for x in LABELLERS]]
    found = [tuple(r) for r in classify(every).select(names).collect()]
    wanted = [(i, *weak_votes(t)) for i, t in [*odd_texts, *more]]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert all(len({r[k] for r in wanted}) > 1 for k in range(1, 11))
    assert out.count() == odd_docs.count() and out.where("kept is null or score is null").count() == 0


@pytest.mark.parametrize("name", ["substring", "jaccard", "lines", "rules", "weak"])
def test_empty_tables(spark, no_docs, name):
    from kilnset.llm.jaccard_join import jaccard_components
    from kilnset.llm.line_dedup import dedup_lines
    from kilnset.llm.quality_rules import fit_quality, quality_rules
    from kilnset.llm.substring_dedup import substring_dedup
    from kilnset.llm.weak_labels import classify

    none = spark.createDataFrame([], "doc_id long, quality int")
    run = {"substring": substring_dedup, "jaccard": jaccard_components, "lines": dedup_lines, "weak": classify,
           "rules": lambda d: quality_rules(d, fit_quality(d, none))}[name]
    assert run(no_docs).count() == 0


def test_reference_pattern_is_ascii_only():
    assert re.fullmatch(r"[^\x20\x09-\x0D]+", "a b")
