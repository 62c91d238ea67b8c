"""The registered queries as they are: those with SQL against DuckDB, the others by their contracts' columns and counts."""

import zlib
from pathlib import Path

import duckdb
import pytest

from sluice.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


COLUMNS = {
    "op1": "query_id bigint, rank int, vec_id bigint, score double",
    "op2": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint",
    "op3": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5": "doc_id bigint, class_id bigint, class_size bigint",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_columns_and_rows_of_the_contract(spark, duck, name):
    got = QUERIES[name](spark, SF)
    kinds = dict(got.dtypes)
    number = name.split("_")[0]
    for column in COLUMNS[number].split(", "):
        assert kinds[column.split()[0]] == column.split()[1]
    rows = got.collect()
    if number == "op1":
        (queries,) = duck.execute("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()
        assert len(rows) == 5 * queries and all(r["rank"] in range(1, 6) for r in rows)
        return
    (docs,) = duck.execute("SELECT count(*) FROM documents").fetchone()
    assert len({r.doc_id for r in rows}) == docs and (number == "op9" or len(rows) == docs)
    if number in ("op6", "op7"):
        folds, held = (5, 0) if number == "op6" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
