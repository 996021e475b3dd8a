"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, block string"


def texts(seed=5, n=60):
    rng = random.Random(seed)
    words = [a + b for a in ("an", "th", "le", "öst", "ció", "re") for b in ("er", "ing", "n", "ö", "la", "")]
    out = [None, "", " ", "\n\n", "a", "x y", "one two three four", "one two three four five",
           "the same line here\nthe same line here\n\nother", "# $ % & | < > *", "naïve 中文 🙂 é", "a" * 3000,
           "#!$ " * 40, "word " * 60, "\t lead and trail \r\n", "it's we're I'll <|endoftext|> don't  two  spaces   "]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) for _ in range(n // 3)]
    for b in base:
        w = b.split(" ")
        out += [b, b, " ".join(w[:-1] + ["changed"]), b.upper()]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    shared = " ".join(rng.choice(words) for _ in range(150))
    out += [long, long + " end", "before " + shared + " after one", shared + " more text", "x " + shared]
    return out


def rows(seed=5, n=60):
    t = texts(seed, n)
    out = [(i * 3 + 1, x, "en", f"src{i % 3}" if i % 7 else None, len(x or ""), "z", None) for i, x in enumerate(t)]
    return out + [out[20], out[20], (None, "a text without an id of its own here", None, None, None, None, None)]


def docs(spark, seed=5, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
