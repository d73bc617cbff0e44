import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with copies, near copies, shared passages, nulls, blanks, long
    words, repeated lines, other white space and repeated ids."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgÉßñü") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        out = []
        for k in range(n):
            out.append(rng.choice(vocabulary))
            out.append(rng.choice([" ", " ", " ", " ", "\n", "\t", "  ", " \r\n", " ", "\x0b"]))
        return "".join(out)

    passage = prose(60)
    base = prose(150)
    texts = [base, base, base.upper(), passage, prose(40) + "\n" + passage + "\n" + prose(30), passage + prose(5)]
    for _ in range(6):  # near copies
        parts = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
        texts.append(" ".join(parts))
    for _ in range(5):
        lines = ["one two three four five six seven eight nine ten".split() for _ in range(6)]
        for line in lines:
            line[rng.randrange(10)] = rng.choice(["one", "x", "y"])
        texts.append("\n".join(map(" ".join, lines)) + "\n\n" + "same line here\n" * 3)
    texts += ["", None, " ", "\n\n", "word", "word", "two words", "a b c d", "a b c d", "x" * 5000, "la " * 300,
              "# * $ % & | < >", None, "end\n", "\n start", "la la la " * 20 + passage]
    texts += [prose(rng.randint(1, 60)) for _ in range(10)]
    rows = [(i * 3 % 97, t) for i, t in enumerate(texts)]
    rows += [(None, base), (None, passage), (None, None), (5, base), (5, "other words of the same id " + passage), rows[0]]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns whose names clash with those of operators."""
    rows = [(i, t, None if k % 7 == 0 else f"s{k % 4}", k, 1.5, "x") for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, rank int, n_words double, kept string").repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, rank int")
