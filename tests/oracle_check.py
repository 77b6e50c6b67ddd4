"""Every query with SQL against DuckDB on a folder of tables."""

import duckdb


def differences(spark, folder, names=None):
    import __spark_entry__ as entry

    con = duckdb.connect()
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = {}
    for name, sql in entry.oracle_sql().items():
        if names is not None and name not in names:
            continue
        ours = entry.queries()[name](spark, folder).toPandas()
        theirs = con.execute(sql).df()
        rows = [sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name="r"))) for d in (ours, theirs)]
        if sorted(ours.columns) != sorted(theirs.columns) or rows[0] != rows[1]:
            found[name] = [[x for x in a if x not in set(b)][:2] for a, b in (rows, rows[::-1])] + [list(map(len, rows))]
    return found
