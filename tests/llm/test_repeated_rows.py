"""Rows that occur twice count once among the rows of a column."""

import pyarrow as pa

from tracewright.llm import ngram_join


def met(rows):
    columns = zip(*sorted(rows))
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["column", "doc_id", "info"])
    return sorted(tuple(r.values()) for out in ngram_join._met(iter([batch.slice(0, 5), batch.slice(5)])) for r in out.to_pylist())


def test_repeated_rows_make_the_same_blocks():
    rows = [(c, d, (d << 32) | 10) for c, docs in ((1, (1, 2, 3)), (2, (2, 3)), (3, (1, 3)), (4, (4,)), (5, (2, 3))) for d in docs]
    once = met(rows)
    assert len({r[0] for r in once}) == 3 and met(rows * 2) == once and met(rows + rows[:4]) == once
