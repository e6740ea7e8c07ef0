import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import exact_dedup as E


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**62 - 1), max_size=80))
def test_golomb_round_trip(values):
    ordered = np.sort(np.array(values, np.uint64))
    assert np.array_equal(E.golomb_decode(E.golomb_encode(ordered, 0, 2**62), 0), ordered)


def brute(rows):
    least = {}
    for i, text in rows:
        if i is not None and text is not None:
            least[text] = min(i, least.get(text, i))
    return {(i, least[t]) for i, t in rows if i is not None and t is not None and least[t] != i}


ROWS = [(5, "a"), (3, "a"), (9, "a"), (9, "a"), (3, "a"), (1, ""), (2, ""), (None, "a"), (4, None), (4, None), (6, "x" * 300_000), (7, "x" * 300_000), (8, "x" * 299_999 + "y"), (10, "b")]


def test_pairs_equal_brute_force(make):
    for clash in (False, True):
        assert {tuple(r) for r in E.duplicate_pairs(make(ROWS, clash)).collect()} == brute(ROWS)


def test_one_row_of_each_text_stays_and_columns_too(make):
    docs = make(ROWS, clash=True)
    kept = E.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=repr)
    assert got == sorted([(3, "a"), (1, ""), (None, "a"), (4, None), (4, None), (6, "x" * 300_000), (8, "x" * 299_999 + "y"), (10, "b")], key=repr)
    assert all(r[5] == f"__dq_id-{r[0]}" for r in kept.collect())


def test_different_texts_with_one_fingerprint(make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "bb")]
    assert {tuple(r) for r in E.duplicate_pairs(make(rows)).collect()} == {(3, 1), (5, 2)}


def test_empty_table(make):
    assert E.duplicate_pairs(make([])).count() == 0 and E.drop_exact_duplicates(make([])).count() == 0


def test_text_ids_many_owners_and_empty_partitions(make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "OWNER_ROWS", 2)
    docs = make([(i, f"t{i % 5}") for i in range(12)]).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 2, "0"))).repartition(30)
    assert {tuple(r) for r in E.duplicate_pairs(docs).collect()} == {(f"d{i:02}", f"d{i % 5:02}") for i in range(5, 12)}
    assert sorted(r.doc_id for r in E.drop_exact_duplicates(docs).collect()) == [f"d{i:02}" for i in range(5)]


def test_no_rdds_of_python_whose_workers_stay_beside_those_of_sql(make, monkeypatch):
    from pyspark import RDD

    docs = make(ROWS)

    def refused(*_, **__):
        raise AssertionError("an RDD of Python has workers of its own, as many as its steps, beside the two of SQL")

    monkeypatch.setattr(RDD, "mapPartitionsWithIndex", refused)
    assert {tuple(r) for r in E.duplicate_pairs(docs).collect()} == brute(ROWS)
