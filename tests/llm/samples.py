"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
# names that operators use for their own columns
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, rate double, "
    "score double, label string, doc string, a long, n long, kept boolean, row long, w string"
)
WORDS = "the of and to in is it was for on as with by at from this that be are or".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def awkward(spark, extra: list[tuple] = ()):  # (doc_id, text, source)
    rng = random.Random(3)
    long = " ".join(sentence(rng, 40) for _ in range(400))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "x" * 50_000, "b"),
        (6, long, "c"), (7, long, "c"), (8, "same words here now", "b"), (8, "same words here now", "b"),
        (None, "no id at all", "a"), (9, "ünï çödé   \x00 \U0001F600 İſK", "ß"), *extra,
    ]
    full = [
        (d, t, "en", s, None if t is None else len(t), 7, 0.5, 0.5, "l", "d", 1, 2, True, 3, "w")
        for d, t, s in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
