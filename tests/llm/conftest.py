import random

import pytest

WORDS = "the cat sat on a mat and saw two dogs run past old red barn while rain fell over green hills near town".split()


@pytest.fixture(scope="session")
def cases():
    """doc_id, text: null, empty, blank, short, tied, repeated, near copies, long, odd characters."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "er"]) for _ in range(n))
    a = prose(200)
    near = a.split()
    near[100] = "CHANGED"
    far = [w if i % 5 else w + "x" for i, w in enumerate(a.split())]
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (7, a), (8, a.upper()), (9, " ".join(near)), (10, " ".join(far)),
        (11, prose(6000)), (12, "don't we'll  they're\n\n  'x' <|endoftext|> 12345 ½ naïve 日本語    end  "), (12, "don't we'll  they're\n\n  'x' <|endoftext|> 12345 ½ naïve 日本語    end  "),
        (None, a), (13, "<|endoftext|>"), (14, "\0nul\0"), (15, "Licensed under the MIT License. apache LICENSE; General-Public license general public license"), (16, "🙂" * 50), (17, "' 's 'll 've 'd"),
    ]
    return rows + [(100 + i, a) for i in range(20)]


def frame(spark, rows, columns="doc_id long, text string"):
    """Rows with columns more, whose names an operator may use itself."""
    extra = ", tokens string, n int, block long, score string, lang string"
    return spark.createDataFrame([(*r, "t", 1, 2, "s", "en") for r in rows], columns + extra)


def empty(spark, columns="doc_id long, text string"):
    return spark.createDataFrame([], columns)
