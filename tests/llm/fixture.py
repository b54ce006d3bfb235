"""Small documents with every awkward case, and plain versions of the operators to hold results against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key int, node string, fp int, at int, _d int, deleted string, length int, bucket int, word string, a int, b int, seed int, chunk int, shard int"


def docs(spark, n=60, seed=3, texts=None):
    """Rows with clashing column names, a null id, null and empty texts, repeated rows, copies, ties and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "é", "in", "st"]) for _ in range(rng.randint(1, 4)))
    line = lambda k=9: " ".join(word() for _ in range(rng.randint(2, k))) + "."
    shared = [line(30) for _ in range(6)]
    made = []
    for i in range(n):
        parts = [line() for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.sample(shared, 3) if i % 8 else shared[:4]
        made.append((i, rng.choice(["\n", " "]).join(parts)))
    made[7] = (7, made[3][1])
    made[9] = (9, made[4][1].replace("th", "TH", 1))
    made += [(n, ""), (n + 1, None), (n + 2, "  \n\t "), (n + 3, "one"), (None, made[2][1]), made[5], made[5], (n + 4, " ".join(word() for _ in range(3000))), (n + 5, "a " * 60), (n + 6, ""), (n + 7, "x" * 120), (n + 8, "x" * 90)]
    if texts is not None:
        made = texts
    return spark.createDataFrame([(i, t, "en", "s", None, *([1] * 2), "n", *([1] * 3), "d", 1, 1, "w", *([1] * 5)) for i, t in made], SCHEMA).repartition(3), made


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, made):
    """Results keyed by (id, nth of that id), for comparing repeated rows."""
    return sorted(rows, key=str)
