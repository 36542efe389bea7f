"""Documents at the edges: nulls, empty and very long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, source=lambda i: f"s{i % 3}", lang=lambda i: "en"):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(d, t, lang(i), source(i), None if t is None else len(t)) for i, (d, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_texts(seed: int = 1) -> list:
    rng = random.Random(seed)
    base = prose(rng, 120)
    return [None, "", " ", "\n\n", "a", "é ü 漢字 🙂", base, base, base + " x", prose(rng, 30000), "same line\nsame line\nother\nsame line\n", "w " * 500, "#*$ %&|<> " * 40, prose(rng, 19), prose(rng, 20), "a\tb\x0bc\x0cd\re\x1cf g", None, ""]
