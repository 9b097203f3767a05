"""Small frames with the awkward cases: nulls, empties, repeats, ties, long texts, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, bits long, shard int, spans string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box five hens near old mills under grey rain".split()


def text(seed: int, words: int = 40, lines: int = 3) -> str:
    draw = random.Random(seed)
    return "\n".join(" ".join(draw.choice(WORDS) for _ in range(words // lines)) for _ in range(lines))


def docs(spark, rows, repeats=0):
    """rows: (doc_id, text); every other column clashes with a name the operators use inside."""
    rows = [(i, t, "en", None, None, 7, 7, 7, "x") for i, t in rows]
    return spark.createDataFrame(rows + rows[:1] * repeats, DOCS)


def awkward(spark):
    return docs(
        spark,
        [
            (1, text(1)),
            (2, None),
            (3, ""),
            (None, text(1)),
            (None, "loose row"),
            (4, "   \n\t\n"),
            (5, text(1)),
            (6, "ÄÖ ß 🙂   x"),
            (7, "word " * 30000),
            (8, text(8)),
            (8, text(9)),
        ],
        repeats=1,
    )


def empty(spark):
    return docs(spark, [])
