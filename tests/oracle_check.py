"""Run registered queries next to their SQL on DuckDB: python tests/oracle_check.py FOLDER [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value) if not isinstance(value, str) else value


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def kind(name):
    name = str(name).lower()
    if name.startswith(("bigint", "int", "hugeint", "ubigint")):
        return "integer"
    if name.startswith(("varchar", "string")):
        return "string"
    return name


def compare(spark, con, folder, name, query, sql):
    """None when the results agree, else what differs."""
    df = query(spark, folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, [kind(d[1]) for d in cursor.description]))
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} != {names}"
    mine_types = {n: kind(t) for n, t in df.dtypes}
    off = {c: (mine_types[c], types[c]) for c in names if mine_types[c] != types[c]}
    order = sorted(names)
    mine = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    other = sorted(tuple(normal(r[names.index(c)]) for c in order) for r in theirs)
    if mine != other:
        extra = [r for r in mine if r not in set(other)][:2]
        lacking = [r for r in other if r not in set(mine)][:2]
        return f"{len(mine)} != {len(other)} rows; only here {str(extra)[:700]}; only there {str(lacking)[:700]}"
    return f"types {off}" if off else (None if mine else "no rows")


def main():
    from sluice.session import local_session

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, name, query, oracles[name])
            else:
                problem = f"rows only: {len(query(spark, folder).collect())}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)


if __name__ == "__main__":
    main()
