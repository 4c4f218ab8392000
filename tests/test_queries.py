"""Every query with an oracle gives the oracle's rows."""

import math
import random
from pathlib import Path

import duckdb
import pytest

from millrace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_oracle_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_reasons_of_answers_cut_at_a_space(spark, tmp_path):
    said = [(i, t, ("user", "assistant")[t % 2], "a question" if t % 2 == 0 else "nine char and more words of an answer") for i in range(16) for t in range(2)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("quality_reasons", "reason_counts"):
        mine = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert mine == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert ("answer too short: 10", 2) in mine


def test_filtered_conversations_leave_their_text_on_disk_once(spark, tmp_path):
    """Neither messages, nor answers beside their conversations, nor packed texts are there when the result is run."""
    rng = random.Random(13)
    said = [(i, t, ("user", "assistant")[t % 2], "".join(rng.choices("abcdefghij ", k=2000))) for i in range(200) for t in range(4)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    assert sorted(map(tuple, catalog.QUERIES["filtered_conversations"](spark, str(tmp_path)).collect())) == [(i, 4) for i in range(200)]
    assert size() - before < 0.6 * sum(len(r[3]) for r in said)
