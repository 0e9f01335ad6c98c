import glob
import os

import duckdb
import pytest

from specweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want) and len(got)


def test_windows_by_sql_under_a_small_budget(spark, monkeypatch):
    """Long histories, system turns, turns beyond the budget, ties and null ids."""
    import numpy as np

    from specweave.llm import chat

    r = np.random.default_rng(1)
    words = ["a", "b\n", "</s>", "[INST]", "\\", "é"]
    rows = [(c, t if r.random() > 0.05 else None, "system" if t == 0 and (c or 0) % 3 == 0 else ("user", "assistant")[t % 2], " ".join(r.choice(words, int(r.integers(0, 400)))) if r.random() > 0.1 else None) for c in [*range(1, 30), None] for t in range(int(r.integers(1, 40)))]
    rows += rows[:5]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(queries.ORACLE_SQL["op10_chat_formatting"]).fetchall()
    said = "</s>[INST] ok [/INST]"
    frame = spark.createDataFrame([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(frame)
    assert windows.where("window > 2").count() > 10
    assert sorted(map(str, map(tuple, chat.read_back(windows).collect()))) == sorted(map(str, want))
