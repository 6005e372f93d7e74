"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, length int, words string, tree int"


def docs(spark, rows):
    """rows: (doc_id, text); the other columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, 2, "w", 3) for i, t in rows], DOCS)


def awkward():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Délta", "it's", "x1", "中文", "!!", "omega,", "rare" + "z" * 40]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one two"), (55, "a" * 5000), (None, "no id at all here"),
             (56, rows[0][1]), (57, rows[0][1]), (58, rows[0][1]), (3, rows[3][1]), (60, "<|endoftext|> in text"),
             (61, " ".join(rng.choice(words) + str(rng.randint(0, 900)) for _ in range(6000)))]
    rng.shuffle(rows)
    return rows
