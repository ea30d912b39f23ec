"""Queries of the folder, beyond the comparison with their SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyloom.llm import queries
from tallyloom.llm.sql import P3

ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in ROOT.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_p3_scores_every_term_of_every_business(spark, db):
    columns = ["business_id", "term", "with_term", "in_group", "groups_with_term", "groups"]
    theirs = {r[:6]: r[6] for r in db.execute(f"select {', '.join(columns)}, llr from ({P3})").fetchall()}
    ours = {tuple(r[c] for c in columns): r["llr"] for r in queries.p3_scores(spark, str(ROOT)).collect()}
    assert set(ours) == set(theirs)
    assert all(abs(v - theirs[k]) < 2e-4 for k, v in ours.items())
    held = Counter(k[2] for k in ours)
    assert held[1] and held[2] and any(k[3] < 3 for k in ours)
