"""The shared half-up rounding gives identical bits in Spark and DuckDB."""
import random

import duckdb
from pyspark.sql import functions as F

from postlens.functions import columns as C
from postlens.plans.oracle import r2, r4


def test_round_half_up_same_bits(spark):
    rnd = random.Random(5)
    vals = [2.675, 0.125, 0.005, 1.005, 2.5, -2.5, 1e-9, 123456.78905]
    vals += [rnd.uniform(-1e4, 1e4) for _ in range(300)] + [rnd.randint(0, 10 ** 6) / 1000 for _ in range(300)]
    vals += [k / 8 for k in range(-40, 40)] + [n / d for n in range(1, 60) for d in (3, 7, 9, 60000)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = df.select("x", C.round_half_up(F.col("x"), 2).alias("a"), C.round_half_up(F.col("x"), 4).alias("b")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(float(v),) for v in vals])
    want = {x: (a, b) for x, a, b in con.execute(f"SELECT x, {r2('x')}, {r4('x')} FROM t").fetchall()}
    for r in got:
        assert (r["a"], r["b"]) == want[r["x"]], r["x"]
