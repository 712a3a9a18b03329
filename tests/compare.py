"""Runs catalog queries next to their SQL twins: python -m tests.compare FOLDER [names...]"""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
        return [f"rows {len(ours)} vs {len(theirs)}", *map(str, extra)]
    return [f"{a} vs {b}" for a, b in zip(ours, theirs) if a != b][:5]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con, sqls = connect(folder), e.oracle_sql()
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                bad = differences(df, con, sqls[name])
                state = "ok" if not bad else "DIFF " + " | ".join(bad)
            else:
                state = f"rows {df.count()}"
        except Exception as error:
            state = "ERROR " + str(error)[:600]
        print(f"{name:24s} {time.time() - start:6.1f}s {state}", flush=True)
