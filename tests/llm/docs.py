"""Documents with every awkward case, and helpers."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def passage(n: int, start: int = 0) -> str:
    return " ".join(f"w{(i * 7919 + start) % 10007}" for i in range(n))


def rows() -> list[tuple]:
    base = passage(120)
    edited = base.replace("w7919 ", "changed ", 1)
    made = [
        (1, base), (2, base), (3, edited), (4, ""), (5, None), (6, "one"), (7, " \t\n "), (8, "émigré Ünï ß 日本語 text\nline two"), (9, passage(30, 5) + " " + passage(60, 77) + " tail"),
        (10, passage(25, 900) + "\n" + passage(60, 77)), (11, "x" * 5000), (12, passage(30_000, 11)), (13, "The End. <|endoftext|> the"), (None, "a text without an id"), (15, passage(21, 50)), (16, passage(21, 50)), (16, passage(21, 50)),
        (17, "a a a a a a a a a a a a a a a a a a a a a a a a a"), (18, "\x00\x01 control \x1f text\x85 more"), (19, "LOUD!! LOUD!! LOUD!!\nLOUD!!"), (-3, passage(119) + " w1"),
    ]
    return [(i, t, "en" if i is None or i % 2 else "fr", "src", None if t is None else len(t)) for i, t in made]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make or use inside.
CLASHES = ("id", "row", "at", "kept", "score", "predicted", "ids", "decoded", "fp", "component", "__text", "bucket", "n_words", "n_removed", "n_tokens", "n", "rows", "digest", "copy", "text_", "hash", "Score")


def frame(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("c").alias(c) for c in CLASHES if c != "Score"])


def table(spark, tmp_path, given=None, **others) -> str:
    """A folder of tables like the test data's."""
    frame(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    for name, df in others.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
