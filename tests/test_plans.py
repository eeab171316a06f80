import math

import duckdb
import pytest

import __spark_entry__ as entry
from hemispark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings events utterances debates speaker_registry party_alignment utterance_policy_labels doc_labels eval_items mix_targets".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if type(v).__name__ in ("int", "float", "Decimal") else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    # the smallest tables have fewer cells than the mixed model has terms
    df = catalog.queries()[name](spark, SF.replace("0.001", "0.01") if name == "mixed_model" else SF)
    rows = df.collect()
    assert df.columns and rows and all(any(v is not None for v in r) for r in rows)


def test_sizes_are_those_of_the_reference(spark):
    large = "/root/testdata/sf0.1"
    words = {r.token: r.id for r in catalog.queries()["vocabulary_full"](spark, large).collect()}
    assert len(words) > 500
    rows = {(r.debate_id, r.seq_index): r.ids.split() for r in catalog.queries()["encode_vocab"](spark, large).collect()}
    assert {len(ids) for ids in rows.values()} == {50} and any(ids[16] != "0" for ids in rows.values()) and len({i for ids in rows.values() for i in ids}) > 500
    labels = spark.read.parquet(f"{large}/utterance_policy_labels.parquet").distinct()
    none = labels.where("predicted_label = 'non_policy'").count()
    kept = catalog.queries()["exact_n_sample"](spark, large)
    assert kept.where("predicted_label = 'non_policy'").count() == min(5000, none) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
