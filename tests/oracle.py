"""Holds queries against their SQL: ``python tests/oracle.py SF_DIR [QUERY...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.sql(sql)
    theirs = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} {sorted(found.columns)}"
    if ours == theirs:
        return f"ok {sum(ours.values())}"
    return f"differs: {sum(ours.values())} {sum(theirs.values())}\n   only Spark {list((ours - theirs).items())[:3]}\n   only SQL   {list((theirs - ours).items())[:3]}"


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con, queries, oracles = connection(sf), entry.queries(), entry.oracle_sql()
    for n in names or [k for k in queries if not k.startswith("op") and k != "pipeline"]:
        began = time.time()
        try:
            said = compare(spark, con, sf, n, queries[n], oracles[n]) if n in oracles else f"rows {queries[n](spark, sf).count()}"
        except Exception as e:
            said = f"FAILED {str(e)[:700]}"
        print(n, round(time.time() - began, 1), said, flush=True)
