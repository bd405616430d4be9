"""Documents with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, found string, rules long, fp long, score double"


def odd_documents(spark, n: int = 60, seed: int = 1):
    rng = random.Random(seed)
    words = [rng.choice("abcdefghéßñ") * rng.randint(1, 3) + rng.choice(["ing", "tion", "eau", "ung", ".", "|"]) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts = [None, "", " \t\n", "one", "One", "two words", "ONE\x0btwo\x0cthree\rfour", "x" * 5000, text(6000), "\U0001f600 \u0130 \u00a0 nbsp\u2003em", "tab\tand  two  spaces"]
    base = text(200)
    texts += [base, base, base.replace("ing", "ing,", 1), base + " end", base.upper()]
    texts += [text(rng.randint(1, 120)) for _ in range(n - len(texts))]
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or ""), "clash", "clash", 7, 8, None) for i, t in enumerate(texts)]
    rows.append(rows[11])  # a row that occurs twice
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
