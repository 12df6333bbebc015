import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Cases that every operator must take: null, empty, blank, short, repeated rows, null and repeated ids, a very long word.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "same text here now again"), (904, "same text here now again"), (None, "no id at all here"), (905, "x" * 30_000), (906, "ünïcode Straße ça va bien")]


def prose(rng, n):
    parts = ("re", "th", "an", "er", "on", "ing", "ed", "es", "da", "mo", "ka", "lu")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=1, n=40):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(n)]
    for k in range(0, n, 5):  # near and exact copies
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts += [texts[k], " ".join(words), " ".join(words[: len(words) * 4 // 5])]
    return [(k, t) for k, t in enumerate(texts)] + ODD


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    full = [(k, t, "en", f"s{(k or 0) % 7}", len(t or "")) for k, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:  # names that operators use inside must not matter
        df = df.withColumns({c: F.lit(1) for c in ("rid", "score", "rank", "node", "length", "digest", "component_id", "quality", "size", "words")})
    return df
