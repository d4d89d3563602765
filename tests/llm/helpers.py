"""Small tables for the operators' tests, with the odd rows that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start string"

WORDS = "the of and to in that it was for on with as be by at river stone light north water house field garden".split()


def prose(rng: random.Random, words: int) -> str:
    out = []
    for n in range(words):
        out.append(rng.choice(WORDS) + (rng.choice([".\n", ". ", ", "]) if n % 9 == 8 else " "))
    return "".join(out).strip()


def odd_documents() -> list[tuple]:
    """Copies, near-copies, nulls, empty and blank texts, a long one, wide characters, repeated rows; two columns that clash."""
    rng = random.Random(5)
    base, other = prose(rng, 80), prose(rng, 60)
    long = " ".join(prose(rng, 40) for _ in range(200))
    texts = [
        base, base, base + " end", base.replace("river", "stream"), other, None, "", "  \n\t ", "one", "one two three",
        long, "Zeile mit Umlauten: äöü ß ÄÖÜ  und 　Weite \U0001f600!" * 9, "aaaa" * 200, "x\n\n\ny\n" * 40, base[:150] + other,
        "<|endoftext|> is text", other.upper(), "a" * 99, "b" * 100, "b" * 101,
    ]
    rows = [(i * 3, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(3, base, "en", "s1", len(base), "clash", "clash"), (12, "same id", "en", "s2", 7, None, None), (None, base, "en", "s1", 1, None, None)]


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
