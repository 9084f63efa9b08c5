"""Small document tables with every awkward case."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score string, h bigint"


def documents(spark, rows):
    """rows: (doc_id, text); other columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], DOCS)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 0, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, one very long text, copies, near copies, ties and repeated rows."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(i, "\n".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, rows[5][1]), (104, rows[5][1]), (105, words(rng, 20_000)), (106, "One"), (107, "one"), (None, rows[7][1]), (None, None), rows[3], rows[3]]
    rows += [(200 + k, rows[9][1] + " " + words(rng, 1)) for k in range(8)]
    rng.shuffle(rows)
    return rows
