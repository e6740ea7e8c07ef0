import corpus_pipeline
import pytest
from conftest import words
from oracle import same

from docquarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tiny, name):
    same(queries.queries()[name](spark, tiny), queries.oracle_sql()[name], tiny)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and len(queries.queries()) == 11
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_stages_keep_the_columns_and_pass_rows_on(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tiny)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        if i in (3, 4):
            assert now == ids
        ids = now


def test_run_gives_the_packing(spark, tiny):
    assert {"doc_id", "bin_id", "bin_offset", "length", "piece"} <= set(corpus_pipeline.run(spark, tiny).columns)


def tables(spark, make, path, rows, labels):
    docs = make(rows, clash=True)
    # Parquet has no columns whose names differ by case alone.
    docs = docs.toDF(*["Text2" if c == "Text" else c for c in docs.columns])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_run_on_rows_of_all_kinds(spark, make, rng, tmp_path):
    near = words(rng, 200)
    rows = [(i, words(rng, 60), f"s{i % 3}") for i in range(12)]
    rows += [(20, near, "s0"), (21, near + " more", "s1"), (22, near, "s2"), (23, "vile scum", "s0"), (24, "vile scum " + words(rng, 40), None)]
    rows += [(None, "no id here", "s0"), (30, None, "s1"), (31, "", "s1"), (32, "", "s2"), (33, words(rng, 30_000, 10**6), None), (34, "x" * 200_000, "s0"), rows[0], rows[0], (None, None, None)]
    labels = [(i, 1, 0) for i in range(12)] + [(23, 0, 1), (24, 0, 1), (None, 1, 1), (3, 1, None)]
    tables(spark, make, tmp_path, rows, labels)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in found}
    assert ids - {23, 24} == {*range(12), 20, None, 33, 34}
    # Every piece of every document that is left is there, as often as the mixing gave the document.
    for i in (33, 34):
        mine = [r.token_from for r in found if r.doc_id == i]
        assert len(mine) % len(set(mine)) == 0 and set(mine) == set(range(0, max(mine) + 1, 2048))
    places = {}
    for r in found:
        places.setdefault(r.bin_id, []).append((r.bin_offset, r.length))
    for pieces in places.values():
        ordered = sorted(pieces)
        assert all(a + n <= b for (a, n), (b, _) in zip(ordered, ordered[1:])) and sum(ordered[-1]) <= 2048


def test_run_on_empty_tables(spark, make, tmp_path):
    tables(spark, make, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from docquarry.llm import _util

    def session(master):
        return SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))

    assert _util.shared_dir(session("local[4]")).startswith("file:")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            _util.shared_dir(session(master))
