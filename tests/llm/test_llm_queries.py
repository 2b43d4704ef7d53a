"""Each query against its SQL on the smallest tables; those without SQL against what must hold of their rows."""

import pyarrow.parquet as pq
import pytest

from conftest import same_rows
from glossmill.llm import lookalike, tokens
from glossmill.llm.queries import ORACLE, QUERIES


def _column(folder, name, *columns):
    return list(zip(*[c.to_pylist() for c in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).columns]))


def _report(rows, folder):
    assert all(0 <= r.quota <= r.available and r.shortfall == max(0, r.requested - r.available) for r in rows)
    assert sum(r.quota for r in rows) == min(_column(folder, "sample_target", "sample_rows")[0][0], sum(r.available for r in rows))


def _sample(rows, folder):
    assert len({r.row_id for r in rows}) == len(rows) == _column(folder, "sample_target", "sample_rows")[0][0]


def _pairs(rows, folder):
    """All pairs of every class by brute force."""
    one, classes = lookalike.transducer(), {}
    for i, lang, *texts in _column(folder, "tail_entry", "entry_id", "target_lang", "source", "target"):
        if lang is not None and None not in texts:
            classes.setdefault((lang, *map(one, texts)), []).append((i, *texts))
    want = {(min(a[0], b[0]), max(a[0], b[0])) for c in classes.values() for a in c for b in c if a[1:] != b[1:]}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def _forms(rows, folder):
    one = lookalike.transducer()
    want = {i: tuple(None if t is None else one(t) for t in texts) for i, *texts in _column(folder, "tail_entry", "entry_id", "source", "target")}
    assert {r.entry_id: (r.source, r.target) for r in rows} == want


def _classes(rows, folder):
    assert all(r.class_id <= r.entry_id and r.n_links >= 0 for r in rows) and any(r.n_links for r in rows)
    assert {r.class_id for r in rows} <= {r.entry_id for r in rows}


def _ids(rows, folder):
    enc = tokens.encoding()
    assert {r.doc_id: r.ids for r in rows} == {i: enc.encode_ordinary(t or "") for i, t in _column(folder, "documents", "doc_id", "text")}


def _containers(rows, folder):
    load, capacity = {}, dict(_column(folder, "container_spec", "spec_id", "capacity_tokens"))
    for r in rows:
        if r.container_id is not None:
            load[r.spec_id, r.container_id] = load.get((r.spec_id, r.container_id), 0) + r.piece_to - r.piece_from
    assert all(0 < n <= capacity[s] for (s, _), n in load.items())


INVARIANT = {"p5_report": _report, "p5_sample": _sample, "p6_found": _pairs, "p6_forms": _forms, "p6_classes": _classes, "p7_ids": _ids, "p8_containers": _containers}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    if name in ORACLE:
        same_rows(spark, folder, duck, QUERIES[name], ORACLE[name])
    else:
        INVARIANT[name](QUERIES[name](spark, folder).collect(), folder)
