"""Every registered query against its DuckDB oracle on the smallest corpus (the driver runs the
same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from redline.plans.registry import ORACLE, QUERIES, load_all
from redline.sources.tables import TABLES, table_path
from tests.util import canon

load_all()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    return con


def test_every_query_is_registered_with_sql_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert set(ORACLE) <= set(QUERIES)
    assert rows_only == {"pca", "pca_explained_variance", "svd", "edit_script", "template_diff", "diff_hunks", "diff_by_line"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    scols, srows = canon(df.columns, df.collect())
    r = duck.execute(ORACLE[name])
    ocols, orows = canon([d[0] for d in r.description], r.fetchall())
    assert scols == ocols
    assert len(srows) == len(orows)
    assert srows == orows


def _matrix(sf):
    import numpy as np
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{table_path(sf, 'embeddings')}') ORDER BY vec_id").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def test_svd_and_pca_equal_numpy(spark, sf):
    """Scores up to the sign of a component, and the explained variance."""
    import numpy as np
    ids, m = _matrix(sf)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    got = {r.vec_id: r.components for r in QUERIES["svd"](spark, sf).collect()}
    assert np.allclose(np.abs([got[i] for i in ids]), np.abs(m @ vt[:8].T), atol=1e-6)
    c = m - m.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    proj = {r.vec_id: r.components for r in QUERIES["pca"](spark, sf).collect()}
    assert np.allclose(np.abs([proj[i] for i in ids]), np.abs(c @ vt[:8].T), atol=1e-6)
    ratio = [r.explained_variance_ratio for r in QUERIES["pca_explained_variance"](spark, sf).orderBy("component").collect()]
    assert np.allclose(ratio, (s ** 2 / (s ** 2).sum())[:8], atol=1e-9)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["contract_id", "law_firm_id", "contract_type", "n_comparisons", "total_differences",
                          "max_differences"]
    assert all(r.max_differences <= r.total_differences for r in df.collect())


def test_pca_and_svd_of_few_null_and_no_vectors(spark):
    from redline.operators import features as FE
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, None), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    proj, ev = FE.pca(df, 8)
    # Centre (2, 5): one axis holds all variance.
    got = {r.vec_id: r.components for r in proj.collect()}
    assert [abs(round(x, 9)) for x in got[1]] == [1, 0] and got[1][0] == -got[2][0] and got[3] is None and got[4] is None
    assert [round(r.explained_variance_ratio, 9) for r in ev.orderBy("component").collect()] == [1, 0]
    rows, values = FE.svd(df, 1)
    assert len(values) == 1 and {r.vec_id for r in rows.collect() if r.components is None} == {3, 4}
    for empty in (df.limit(0), df.where("vec_id = 3")):
        proj, ev = FE.pca(empty, 8)
        assert ev.count() == 0 and proj.count() == empty.count()
        rows, values = FE.svd(empty, 8)
        assert not len(values) and rows.count() == empty.count()
    one, ev = FE.pca(df.limit(1), 2)
    assert one.first().components == [0, 0] and [r.explained_variance_ratio for r in ev.collect()] == [0, 0]


def test_term_features_of_null_and_wordless_texts(spark):
    from redline.operators import features as FE
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, ""), (4, "a I 1")], "doc_id long, text string")
    assert {(r.doc_id, r.term, r["count"]) for r in FE.count_features(df).collect()} == {
        (1, "alpha", 1), (1, "beta", 2), (1, "alpha beta", 1), (1, "beta beta", 1)}
    assert {r.term: r.tfidf for r in FE.tfidf_features(df).collect()} == {"alpha": 0.377964, "beta": 0.755929,
                                                                            "alpha beta": 0.377964, "beta beta": 0.377964}
    for none in (df.where("doc_id > 1"), df.limit(0)):
        for out in (FE.count_features(none), FE.tfidf_features(none)):
            assert out.count() == 0 and out.columns[:2] == ["doc_id", "term"]
    assert {r.term for r in FE.count_features(df, max_features=1).collect()} == {"beta"}
