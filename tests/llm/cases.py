"""Rows with what can go wrong: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

TURN = random.Random(3)
WORDS = [f"{a}{b}" for a in ("the", "or", "an", "lin", "é", "Str", "Kö") for b in ("", "ing", "ed", "ß", "a,", "o.")]


def text(n, turn=TURN):
    return " ".join(turn.choice(WORDS) + ("\n" if turn.random() < 0.05 else "") for _ in range(n))


BASE = text(120)
LONG = text(9000)
ODD = [
    (1, BASE), (2, BASE), (3, BASE + " more words here"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, LONG), (10, LONG + " " + text(20)),
    (11, text(300)), (11, text(80)), (12, BASE), (12, BASE), (None, text(60)), (None, BASE), (13, "日本語 テキスト 🎉 " * 30), (14, "x" * 5000), (15, "Same same same same same same same same same same"),
    (16, text(40) + "\n" + BASE[:200] + "\n" + text(40)), (17, "\t tabs  and\r\nbreaks   \n\n here\n"), (18, "a b c d e f g h i j k l"), (-5, text(50)), (2**62, text(30)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, ids string, label int, key string"


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", 1, "k") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
