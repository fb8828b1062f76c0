"""Small document tables with the awkward cases, and a stand-in for the word rule."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ta", "re", "on", "mi", "sel", "dor", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def awkward() -> list[tuple]:
    long = prose(1, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(2, 40)), (5, prose(2, 40)), (6, prose(2, 40)),
        (None, prose(3, 30)), (None, None), (7, long), (8, "x" * 50_000), (9, "Ünïcode\x1c 　 text 中文。"),
        (10, "A\nA\nA\n" + prose(4, 20)), (11, "a b " * 400), (2**62, prose(5, 60)), (-3, prose(6, 15)),
    ]


def documents(spark, rows=None, extra: bool = True):
    """The rows as ``documents``, with further columns named like results and inner columns."""
    rows = awkward() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if extra:
        for name in ("score", "kept", "row", "text_hash", "fp", "_text", "_row", "_class", "spans", "a.b", "length", "file"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return documents(spark, [])


def by_id(df):
    """Rows in a fixed order: by id, nulls first, then all else."""
    return sorted(df.collect(), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))
