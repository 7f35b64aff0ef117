import random

#: Columns whose names clash with those that the operators use inside.
EXTRA = {"score": "x", "y": 1, "h": 2, "sig": "s", "key": "k", "n_tokens": 3, "bucket": 4, "_id": 5, "_key": 6, "kept": True, "w": "w", "text_key": 7, "start": 8, "fp": 9}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, y int, h int, sig string, key string, n_tokens int, bucket int, "
          "_id int, _key int, kept boolean, w string, text_key int, start int, fp int")


def frame(spark, rows):
    """Documents from (doc_id, text[, lang]), with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), *EXTRA.values()) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n, stock=400):
    """Invented text of n words."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "ne", "ti", "ro", "lu", "sa", "mi"]) for _ in range(r.randint(1, 4))) for _ in range(stock)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def odd_rows():
    """NULL ids and texts, empty and blank texts, repeated rows, one id with two texts, ties, a very long text."""
    base = prose(1, 120)
    return [(1, base), (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, prose(2, 30_000)), (7, "one two"), (8, "one two"),
            (7, prose(3, 80)), (9, "x" * 100_000), (10, "Ünï çødé 漢字 😀 " * 30), (11, base.replace("ba", "ba ", 1))]
