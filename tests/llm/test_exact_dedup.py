import hashlib
import uuid

import pytest

from tests.compare import connect, differences
from veilcell.llm import exact_dedup as dd

from .helpers import documents, odd_rows

FOLDER = "/root/testdata/sf0.001"


def expected(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        left = 1
        for d in ids:
            kept = d == keep and left > 0
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [odd_rows(), [], [(None, "a", None)] * 3, [(i, "same", "s") for i in range(500)]])
def test_verdicts(spark, rows):
    docs = documents(spark, rows)
    index = dd.add_batch(dd.temporary_index(spark), docs)
    assert sorted(map(tuple, dd.verdicts(docs, index).collect()), key=repr) == expected(rows)
    kept = dd.unique_rows(docs, index)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in expected(rows))


def test_later_batches_meet_the_index(spark):
    index = dd.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    dd.add_batch(index, documents(spark, [(1, "a", None), (2, "b", None)]))
    rows = dd.add_batch(index, documents(spark, [(9, "a", None), (3, "c", None), (4, "c", None)]))
    assert sorted((r.keep_id, r.group_size) for r in rows.collect()) == [(1, 1), (2, 1), (4, 2)]
    later = documents(spark, [(9, "a", None), (3, "c", None), (4, "c", None)])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in dd.verdicts(later, rows).collect()) == [(3, 4, False), (4, 4, True), (9, 1, False)]


def test_query_equals_its_sql(spark):
    assert not differences(dd.op4_exact_dedup(spark, FOLDER), connect(FOLDER), dd.OP4_SQL)
