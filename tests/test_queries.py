"""Every alignment query against its SQL, on tables of a few rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from plaitwork import registry
from plaitwork.plans import oracle as O

TABLES = {
    "documents": ("doc_id long, text string", [(0, "GATTACA " * 9), (1, "Ein zwei éç drei vier fünf sechs sieben acht neun"), (2, "x"), (3, "a b c d " * 12), (4, "tab\there  two\nlines " * 4)]),
    "conversations": ("conv_id long, turn long, text string", [(0, 0, "hello there"), (0, 1, "hello you there"), (0, 2, ""), (1, 0, "alone"), (2, 1, "ab"), (2, 2, None)]),
    "part": ("p_partkey long, p_name string, p_type string", [(1, "small ring", "ECONOMY"), (2, "red widget", "PROMO RING"), (3, "gear", "REDGEAR"), (4, "blue gadget", "BLUE GADGE"), (5, "gasket", "STANDARD GASK"), (9, "tin tin tin", "TINTIN"), (10, "abcabc", "ACBACB")]),
    "customer": ("c_custkey long", [(0,), (1,), (7,)]),
    "events": ("event_id long, user_id long, value double, props string", [(i, i % 3, i * 3.7 % 50, f'{{"k": {i * 7 % 90}}}') for i in range(60)]),
}

#: SQL that is too slow on whole tables of long texts, so that it isn't registered.
SLOW = {
    "nw_path_turns": O.path_sql(O.TURN_PAIRS, O.TURN_KEYS),
    "nw_alignment_turns": O.alignment_sql(O.TURN_PAIRS, O.TURN_KEYS),
    "nw_split_turns": O.split_sql(O.TURN_PAIRS, O.TURN_KEYS),
    "sw_score_tiled_turns": O.sw_sql(O.TURN_PAIRS, O.TURN_KEYS).replace("cast(best as int)", "cast(best as bigint)"),
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    top, db = tmp_path_factory.mktemp("tables"), duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        path = str(top / f"{name}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        db.sql(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    return str(top), db


@pytest.mark.parametrize("name", [*registry.QUERIES])
def test_query(spark, small, name):
    path, db = small
    got = registry.QUERIES[name](spark, path)
    want = db.sql({**registry.SQL, **SLOW}[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    places = [want.columns.index(c) for c in order]
    plain = sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == plain


def test_pairs_are_dealt_to_many_tasks(spark, small):
    from plaitwork.plans import workload

    for pairs in (workload.record_pairs, workload.turn_pairs, workload.part_pairs):
        dealt = pairs(spark, small[0])
        assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.SQL) <= set(entry.oracle_sql())


def test_scheduled_scores_have_team_sizes(spark, small):
    got = {(r["conv_id"], r["turn"]): (r["score"], r["team_size"]) for r in registry.QUERIES["sw_score_scheduled"](spark, small[0]).collect()}
    assert got == {(0, 0): (7, 2), (0, 1): (0, 1), (2, 1): (0, 1)}
