"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, rid long, kept string, `a.b` int, _0 string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "ru", "se", "no"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    long = words(30_000, 1)
    texts = [None, "", " \n\t", "one", "two words", words(60, 2), words(60, 2), words(60, 2) + " ", "  " + words(60, 2), long, long + " tail", words(300, 3), words(300, 3) + " x", "a\x00b " * 30, "é" * 500, "same line\n" * 60, "\x0b\x0c", "x " * 5000, "THE END!! " * 40, "漢字 カナ <|endoftext|> Σ"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "c", 7, "yes", 1, "z") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, words(60, 2), "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (None, words(40, 9), None, "s1", 3, None, None, None, None, None)]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
