import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows, columns=DOCS):
    """Documents from (doc_id, text) or whole rows."""
    whole = [(*r, None, None, None) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(whole, columns)


def words(seed, n, size=400):
    r = random.Random(seed)
    pool = [f"{a}{b}{c}" for a in "kmprst" for b in "aeiou" for c in ("lan", "der", "mis", "tor")]
    return " ".join(r.choice(pool[:size]) + r.choice(["", "", "", ".", ","]) for _ in range(n))
