"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for les des une que und der die nicht para con".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ra", "ti", "on"]) for _ in range(n))


def rows(seed=7, n=60):
    rng = random.Random(seed)
    out = [(i, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None]), 0) for i in range(n)]
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "a", 0),
        (n + 2, " \t\n\x0b ", "en", "b", 0),
        (None, out[3][1], "en", "a", 0),
        (n + 3, out[3][1].upper(), "en", "a", 0),
        (n + 4, out[4][1] + " tail", "en", "b", 0),
        (n + 5, "ÄÖ é x \U0001f600 <|endoftext|> ß", "de", "z", 0),
        (n + 6, sentence(rng, 30_000), "en", "a", 0),
        (5, out[5][1], out[5][2], out[5][3], 0),
        (6, "another text of the same id", "en", "b", 0),
        (n + 7, "word", "en", "ä", 0),
    ]
    return out


def table(spark, seed=7, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)
