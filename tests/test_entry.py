import subprocess
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p2_found", "p7_found", "list_default"} <= set(names)


def test_nothing_else_needs_the_text_operators():
    code = "import sys, importlib, pkgutil, grainmill\nfor m in pkgutil.walk_packages(grainmill.__path__, 'grainmill.'):\n    if not m.name.startswith('grainmill.llm'):\n        importlib.import_module(m.name)\nassert not [m for m in sys.modules if m.startswith('grainmill.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_queries_agree_with_their_sql(spark, data):
    import math

    import duckdb
    from decimal import Decimal

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "grants", "sam_opportunities", "grants_gov_hits", "raw_grants", "source_registry", "ref_locations", "ref_industries", "source_plan"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")

    def plain(v):
        if isinstance(v, float | Decimal):
            return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
        return v

    queries, wrong = entry.queries(), {}
    for name, sql in entry.oracle_sql().items():
        df = queries[name](spark, data)
        columns = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
        if sorted(names) != columns or mine != theirs:
            wrong[name] = (columns, sorted(names), len(mine), len(theirs), [x for x in zip(mine, theirs) if x[0] != x[1]][:2])
    assert not wrong, wrong
