"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

DDL = "doc_id long, text string, lang string, kept boolean, key string"

_WORDS = ["the", "of", "Río", "é", "naïve", "A1", "b-c", "日本", "zeta", "Theta", "42", "x"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(_WORDS) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def documents() -> list[tuple]:
    base = prose(1, 400)
    words = base.split(" ")
    near = " ".join(words[:200] + ["changed"] + words[201:])
    texts = [
        None, "", " \n\t", "one", "One two  three", base, base, near, base.replace(" ", "\n", 3), prose(2, 5000),
        base[:700] + prose(3, 300), prose(4, 80) + base[300:1100] + prose(5, 90), "aaaa" * 300, "a " * 300, "b" + "a " * 300, prose(6, 60), "é" * 49, "é" * 60, "é" * 60 + "!",
    ]
    rows = [(k, t, "en", True, "k") for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows += [(100 + k, f"{prose(50 + k, 60)} {prose(7, 70)}", None, None, None) for k in range(30)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DDL).repartition(3)
