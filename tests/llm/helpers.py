"""Documents with odd rows, and brute-force versions."""

from __future__ import annotations

import random

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join("".join(rng.choices(LETTERS, k=2 + rng.randrange(size) % 6)) for _ in range(n))


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    long = words(rng, 20_000)
    passage = words(rng, 60)
    return [
        None, "", " \t\n ", "one", "one two", passage, passage, f"{words(rng, 40)} {passage} {words(rng, 40)}", f"{words(rng, 30)}\n{passage}", long, long[: len(long) // 2],
        "a " * 300, "a " * 300, "ÄÖÜ ñandú   日本語", "x" * 5000, "12345 67890", passage.upper(), *[words(rng, 50) for _ in range(12)],
    ]


def odd_documents(spark, texts=None):
    """Ids repeat, one is null, other columns have nulls, and more columns have names that operators use inside."""
    texts = odd_texts() if texts is None else texts
    rows = [(None if i == 3 else (4 if i == 5 else i), t, None if i % 5 == 0 else ("en" if i % 2 else "de"), None if i % 7 == 0 else f"src{i % 4}", None if t is None else len(t), i, "x", i * 1.0, f"s{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, key string, coverage double, spans string")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
