"""Small documents with the cases that every operator has to bear."""

import random


def documents(spark, rows=None, extra=True):
    rng = random.Random(7)
    words = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "ou", "ir")]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 6, 30, 60, 120, 400)]
    texts = [None, "", "   ", "\n", "Ünïcode ñandú 日本語 😀", "x", *base, *base, "A" * 5000, "wörd " * 3000, base[3].upper(), base[3] + " tail"]
    for _ in range(20):
        own = rng.choice(base[2:]).split()
        own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(rng.choice(["\n", " ", "  "]).join(own))
    rows = rows if rows is not None else [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), len(t or "")) for k, t in enumerate(texts)] + [(6, base[0], "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:  # columns with names that operators use themselves
        names = ("node", "file", "row", "score", "lang_pred", "n_lines", "queue", "__source", "id", "text_", "class", "gid", "low", "position", "payload", "blob", "c0", "k0")
        return spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in names)) for r in rows], schema + "".join(f", `{c}` string" for c in names))
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark, [])


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def long_text(words=300_000):
    """About 2 MB with few repeats."""
    rng = random.Random(3)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) + "\n" + "\n".join(f"line {k} of many {k * k} ones" for k in range(20_000))
