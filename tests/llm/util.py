import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [None, "", " ", "one", "Ünï cödé \U0001f600 x", "a b c d", "same text here for two rows of it", "same text here for two rows of it", "w " * 3000, "x" * 5000]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    parts = ["ta", "ri", "mon", "es", "lu", "ke", "Va", "sho", "it", "the"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
