import os

import duckdb


def duck(sf_dir, sql):
    """Sorted rows of a DuckDB query over the tables of a folder, with its column names."""
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(([r[i] for i in order] for r in found.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([r[n] for n in names] for r in df.collect()), key=repr)
