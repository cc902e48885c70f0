"""Results of queries against those of their SQL: python tests/compare.py SF_DIR [NAME...]"""

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of_sql(connection, sql, names):
    return Counter(
        tuple(plain(v) for v in r)
        for r in connection.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()
    )


def rows_of_frame(frame, names):
    return Counter(tuple(plain(v) for v in r) for r in frame.select(*[f"`{n}`" for n in names]).collect())


def views(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def main(sf_dir, chosen):
    import __spark_entry__ as entry
    from tremora.session import session

    spark, connection = session(master="local[3]"), views(sf_dir)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), []
    for name in chosen or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            names = sorted(frame.columns)
            got = rows_of_frame(frame, names)
            if name in sql:
                want = rows_of_sql(connection, sql[name], names)
                kinds = dict(zip(*(lambda r: (r.columns, map(str, r.types)))(connection.sql(sql[name])), strict=True))
                same = got == want and sorted(kinds) == names
                print(
                    "OK " if same else "BAD",
                    name,
                    sum(got.values()),
                    sum(want.values()),
                    f"{time.time() - began:.1f}s",
                    flush=True
                )
                if not same:
                    bad.append(name)
                    print("   ", sorted(kinds), list((got - want).items())[:2], list((want - got).items())[:2])
                odd = {
                    n: (t, kinds.get(n)) for n, t in frame.dtypes
                    if {
                        "bigint": "BIGINT",
                        "int": "INTEGER",
                        "double": "DOUBLE",
                        "string": "VARCHAR",
                        "boolean": "BOOLEAN"
                    }.get(t) != kinds.get(n)
                }
                if odd:
                    print("    types", odd)
            else:
                print("-- ", name, sum(got.values()), f"{time.time() - began:.1f}s", flush=True)
        except Exception as e:
            bad.append(name)
            print("ERR", name, str(e)[:400].replace("\n", " "), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
