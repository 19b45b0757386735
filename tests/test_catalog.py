"""Catalog queries against their SQL on the smallest driver tables."""

import os
import random

import pytest

from tracewell.plans import catalog, catalog_rules
from tracewell.plans.evidence import NAMES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
CHEAP = "entity_detail timeline merged_timeline orphan_sweep upload_dedup kind_classifier corpus_state blocking_faults silent_documents counters keyword_search vector_topk near_pairs link_windows link_round_robin link_answers mention_counts entity_normalise merge_resolve components routing_carry routing_filter span_stabbing token_coalesce rel_type assertion_dedupe date_series_expand date_precision consensus_mode evidence_stability required_disposition citation_parse contamination eval_precision_recall title_extract name_collisions transcripts settings_latest".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, list):
        return [plain(v) for v in value]
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


RULES = [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_rules.__name__]


@pytest.mark.parametrize("name", CHEAP + RULES)
def test_query_equals_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF)
    want = oracle.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    found = sorted(str(tuple(plain(v) for v in r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert rows == found


def test_entry_needs_no_training_data_operators():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_of_all_links(spark, tmp_path):
    rng = random.Random(3)
    links = [(rng.randrange(1, 61), rng.randrange(1, 101)) for _ in range(75)]
    spark.createDataFrame(links, "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for supplier, order in links:
        a, b = root(supplier), root(-order - 1)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(up)}
    assert len(set(want.values())) > 3
    got = catalog.QUERIES["components"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_every_order_is_expanded(spark, oracle):
    test_query_equals_sql(spark, oracle, "date_series_expand")
    got = catalog.QUERIES["date_series_expand"](spark, SF).groupBy("o_orderkey").count()
    assert got.count() == oracle.sql("SELECT DISTINCT o_orderkey FROM orders").count("*").fetchall()[0][0]


def test_documents_are_classified_by_their_texts(spark, tmp_path):
    long = "x " * 598
    docs = [(1, "src1", "Sworn STATEMENT of a witness."), (2, "src1", "An interview with the complainant"), (3, "memo", None), (4, "src2", long + "log"), (5, "src2", long + "  log"), (6, "custodian", "Notes on a report"), (7, None, "reports, formal"), (8, "invoice", ""), (9, "x", "the subject's supervisor")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["kind_classifier"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(tuple, c.sql(catalog.ORACLES["kind_classifier"]).fetchall()))
    assert [r[1] for r in got] == ["statement", "interview", "unknown", "record", "unknown", "unknown", "unknown", "unknown", "unknown"]
    assert [r[2] for r in got] == ["witness", "complainant", "witness", "witness", "witness", "custodian", "witness", "witness", "supervisor"]


def test_all_documents_are_classified(spark, oracle):
    test_query_equals_sql(spark, oracle, "kind_classifier")


def test_every_supplier_is_answered(spark, tmp_path):
    suppliers = [(k, f"Supplier {k}") for k in (0, 1, 49, 50, 51, 400)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, catalog.QUERIES["link_answers"](spark, str(tmp_path)).collect()))
    assert got == [(k + 1, f"same {k % 3}", "A", 0.75, name) for k, name in suppliers]


def test_all_answers_equal_sql(spark, oracle):
    test_query_equals_sql(spark, oracle, "link_answers")
