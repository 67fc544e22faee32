import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, node string, bucket long, score double, h string, rank int, __id long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def table(spark, rows):
    """documents of (doc_id, text, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 7, "r", "k", "n", 3, 0.5, "h", 9, 1) for i, t, s in rows], SCHEMA)
