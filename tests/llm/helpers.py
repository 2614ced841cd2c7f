"""Documents for the edge cases that every operator defines, and random texts that share passages."""

import random

from pyspark.sql import functions as F

EDGES = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "a b c d"), (None, None), (4, "x" * 200_000), (5, "w " * 50_000), (6, "É é\tß\n\n")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def clashing(docs):
    """More columns, named like the operators' own."""
    names = ["row", "digest", "kept", "block", "shard", "n_words", "hash", "_decontamination_words", "score_", "ROW_"]
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(names)])


def shared_passages(n, seed, words=12, length=60):
    """Texts over few words, many with passages of others, copies and near copies."""
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdeéß") for _ in range(pick.randint(1, 5))) for _ in range(words)]
    texts = []
    for _ in range(n):
        row = [pick.choice(vocabulary) for _ in range(pick.randint(0, length))]
        for _ in range(pick.randint(0, 2)):
            if texts:
                other = pick.choice(texts).split()
                start = pick.randint(0, len(other))
                row[pick.randint(0, len(row)) : 0] = other[start : start + pick.randint(5, 40)]
        if texts and pick.random() < 0.3:
            row = pick.choice(texts).split()
            if row and pick.random() < 0.7:
                row[pick.randrange(len(row))] = "new" + str(pick.randrange(99))
        texts.append(pick.choice([" ", "\t", "\n "]).join(row))
    return texts
