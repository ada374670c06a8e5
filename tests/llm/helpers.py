"""Small tables with the cases every operator has to handle."""

import random

SHAPE = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use inside.
    "node long, h1 long, n int, name string, pos int, row string, label string, score double, text_sha256 string, hash long, part int"
)


def documents(spark, rows):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "x", 4, "r", "l", 0.5, "h", 5, 6) for i, t in rows], SHAPE)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def odd_rows():
    """Nulls, empties, repeats, ties, one very long text, odd characters."""
    long = prose(9, 60_000)
    return [
        (1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""),
        (None, "one two three four five six"), (None, None), (5, long), (6, long), (7, " "), (8, "\n\n é\u00a0𝄞 ▁ x"), (9, "!!! ... ###"),
        (10, "a"), (10, "b"), (11, "\x00null\x00"), (12, "a1b" * 40_000), (13, "xyz" * 60_000),
    ]


def edited(text, every, seed=0):
    """``text`` with each ``every``-th word replaced."""
    r = random.Random(seed)
    return " ".join(w if (i + 1) % every else f"zz{r.randint(0, 10**6)}" for i, w in enumerate(text.split()))
