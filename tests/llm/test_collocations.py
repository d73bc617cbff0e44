"""Collocations against a plain loop."""

import random
import re
from collections import Counter

import pytest

from kilnset.llm.collocations import collocations, phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for row_lang, text in rows:
            if (row_lang or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                words = tuple(re.findall(r"[^\x20\x09]+", piece))
                n += len(words)
                for size in range(1, 6):
                    f.update(words[i:i + size] for i in range(len(words) - size + 1))
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in held.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if a >= held[p[i:i + size]]:
                        covered.add(p[i:i + size])
        scored = []
        for p, a in held.items():
            if p not in covered:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def check(spark, rows, least, top=2000, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as a", "'x' as phrase", "2 as slice").repartition(3)
    found = [tuple(r) for r in collocations(docs, top, least, **more).select(COLUMNS).collect()]
    expected = plain(rows, least, top)
    assert sorted(found) == sorted(expected)
    return found


def prose(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]) for _ in range(n))


def test_small(spark):
    rng = random.Random(1)
    few = ["the", "The", "of", "é", "É", "字", "a", "b-c", "New", "york"]
    many = few + [f"w{i}" for i in range(60)]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), prose(rng, rng.choice([few, many]), rng.randint(0, 400))) for _ in range(60)]
    rows += [("en", "san francisco bay area bridge toll " * 40), ("fr", "la la la la la la la " * 30), ("xx", "once only"),
             (None, None), ("en", None), ("en", ""), ("en", " . \n"), ("en", "y" * 100_000 + " end")]
    rows += rows[:5]
    assert len(check(spark, rows, 20, top=30)) > 50
    assert check(spark, rows, 5, fan=2, slice_bytes=2000, few=0)


def test_many_words_and_a_dense_tile(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(7000)]
    rows = [("en", " ".join(words[int(rng.random() ** 3 * 7000)] for _ in range(5000))) for _ in range(100)]
    rows += [("en", " ".join(rng.choice(words) for _ in range(3))) for _ in range(500)]
    tail = " ".join(words[-40:])
    rows += [("en", tail)] * 12
    assert len(check(spark, rows, 10, top=10**6, fan=1, slice_bytes=1 << 21, few=0)) > 500


@pytest.mark.parametrize("rows", [[], [("en", None), ("en", "one two three")]])
def test_nothing_frequent(spark, rows):
    assert check(spark, rows, 100) == []


def test_products_beyond_64_bits(spark):
    """The cut and its score on counts that no table at hand has."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**12, 3 * 10**14, 10**13, 7 * 10**12
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    from kilnset.llm.collocations import SCORE

    score = row.select(F.expr(SCORE.format(left="l", right="r"))).first()[0]
    assert score == 1000 * a * n // (left * right)


def test_covered(spark):
    rows = [("en", "x y z.")] * 5 + [("en", "x y.")] * 2
    found = {" ".join(r["words"]): r["covered"] for r in phrases(
        spark.createDataFrame(rows, "lang string, text string"), 5).collect()}
    assert found == {"x y": False, "y z": True, "x y z": False}
