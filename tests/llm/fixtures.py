"""Small documents with the awkward cases: null, empty, white space, very long, ties, repeated rows, clashing extra columns."""

import random


DDL = "doc_id long, text string, chunk string, bucket int, payload string, score double, fp long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    return " ".join(r.choice(pool) for _ in range(n))


def texts():
    shared, base = prose(1, 60), prose(2, 300)
    near = base.split()
    near[150] = "Changed"
    return [
        (0, base), (1, None), (2, ""), (3, " \t\n "), (4, shared), (5, f"{prose(3, 40)}  {shared}\n\n{prose(4, 30)}"), (6, " ".join(near)),
        (7, base), (8, prose(5, 12)), (9, prose(5, 12) + " tail"), (10, prose(5, 12) + " tail"), (11, "One"), (12, "one"), (13, "Ünïcode É x" * 3),
        (14, prose(6, 30000, 5000) + " " + shared), (15, f"{shared} {shared}"), (16, "a " * 40), (17, "a " * 50), (7, base), (None, base), (None, None), (18, f"{prose(9, 5)} {shared[:80]}"),
    ]


def documents(spark, rows=None):
    """With extra columns that are named like what the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5, 7) for i, t in (texts() if rows is None else rows)], DDL)
