"""Each query against its SQL on the smallest tables; those without SQL against what must hold of their rows."""

import pytest

from conftest import same_rows
from glossmill.plans.registry import ORACLE, QUERIES


def _packed(rows, folder):
    """Numbers from 1 without gaps, two values or more, nothing empty or untrimmed."""
    texts = {}
    for r in rows:
        texts.setdefault((r.origin, r.row_id), []).append((r.value_no, r.value_text))
    assert len(texts) > 100 and all(len(v) > 1 and [n for n, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in texts.values())
    assert all(r.value_text and r.value_text == r.value_text.strip() for r in rows)


def _nodes(rows, folder):
    """A node of a document is a part of its text; a document without markup is one node."""
    import pyarrow.parquet as pq

    docs = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).columns]))
    plain = {k for k, t in docs.items() if t and t.strip() and not set("<&") & set(t)}
    assert {r.doc_id for r in rows} >= plain and all(docs[r.doc_id] for r in rows)


INVARIANT = {"p2_found": _packed, "html_text_nodes": _nodes}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    if name in ORACLE:
        same_rows(spark, folder, duck, QUERIES[name], ORACLE[name])
    else:
        INVARIANT[name](QUERIES[name](spark, folder).collect(), folder)


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
