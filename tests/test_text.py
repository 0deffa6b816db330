"""Normalisation and strip goldens (FIXTURES 2.1), hand-written, and randomised checks against the rules in DuckDB SQL."""

import random

from pyspark.sql import functions as F

from chatsift.functions.text import normalize_text, py_strip

GOLDEN = [
    (None, ""),
    ("  a \t b  ", "a b"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("a\n\n\n\nb", "a\nb"),
    ("a​b", "a b"),
    ("‘x’ “y”", "'x' \"y\""),
    (" a  b ", "a  b"),
    ("\u001ca　", "a"),
]


def normalized(texts):
    """Normalised form of each text by the DuckDB statement of the rules (not the Spark expression)."""
    import duckdb
    import pandas as pd

    from chatsift.plans import sqltext as q

    con = duckdb.connect()
    con.register("given", pd.DataFrame({"i": range(len(texts)), "t": pd.Series(texts, dtype=object)}))
    return [r[0] for r in con.execute(f"SELECT {q.normalize('t')} FROM given ORDER BY i").fetchall()]


def test_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", normalize_text("t").alias("n")).collect()}
    for i, (_, want) in enumerate(GOLDEN):
        assert got[i] == want, (GOLDEN[i], got[i])
    assert normalized([t for t, _ in GOLDEN]) == [w for _, w in GOLDEN]


def test_strip_matches_python_on_all_whitespace(spark):
    ws = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "x"]
    rows = [(c, f"{c}a{c}b{c}") for c in ws]
    df = spark.createDataFrame(rows, "c string, t string")
    for r in df.select("c", "t", py_strip("t").alias("s")).collect():
        assert r.s == r.t.strip(), repr(r.c)


def test_random_strings_match_reference_rules(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", " ", "\t", "\r", "\n", "​", "‘", "”", " ", "　", "\x1c", "é"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = dict(df.select("i", normalize_text("t").alias("n")).collect())
    for (i, t), want in zip(rows, normalized([t for _, t in rows])):
        assert got[i] == want, repr(t)


def test_normalize_is_idempotent(spark):
    rng = random.Random(3)
    alphabet = ["a", " ", "\t", "\r\n", "\n", "​", "’", " "]
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string").select(normalize_text("t").alias("n"))
    twice = df.select("n", normalize_text("n").alias("nn"))
    assert twice.where(F.col("n") != F.col("nn")).count() == 0


def test_normalized_output_invariants(spark):
    rng = random.Random(11)
    alphabet = ["a", "b", " ", "  ", "\t", "\r", "\r\n", "\n", "\n\n", "​", "‘", "”", "\xa0",
                "　", "\x0b", " ", "ü"]
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))),) for _ in range(2000)]
    out = [r.n for r in spark.createDataFrame(rows, "t string").select(normalize_text("t").alias("n")).collect()]
    for n in out:
        assert not any(ch in n for ch in "\r\t​‘’“”")
        assert "  " not in n
        for line in n.split("\n") if n else []:
            assert line and line == line.strip()
