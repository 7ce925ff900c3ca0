"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in alpha beta gamma delta omega straße élan 東京 x1 42 mit license apache cc by gnu general public".split()


def odd_documents(spark, extra: bool = False):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 60))), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \t\n ", "en", None), (None, "the of and to null id", "en", "s1"), (None, None, None, None)]
    rows += [(200 + i, rows[3][1], "en", "s2") for i in range(12)]  # copies
    rows += [rows[5], rows[5], rows[5]]  # repeated rows
    rows += [(300, "long " * 30_000 + "\n".join(["same line"] * 50), "en", "s1"), (301, "NUL \x00 and <|endoftext|> !!! ©́", "xx", "S\U0001f600")]
    rows += [(302 + i, f"Shared Line\n\tshared line \nown {i}", "en", "s0") for i in range(11)]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA)
    if extra:  # names that operators use themselves
        for c in ("id", "size", "shard", "fp", "words", "row", "key", "k", "source_size", "keep", "h", "payload", "draws", "tie", "grp", "block", "doc", "part", "label"):
            df = df.selectExpr("*", f"'clash' as {c}")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b) -> bool:
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
