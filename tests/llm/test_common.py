"""Memory of the corpus operators: what goes to a Python worker at once."""

import pyarrow as pa

from brindle.llm.common import BATCH_BYTES, tune


def test_batches_are_bounded_by_bytes(spark):
    tune(spark)
    size = 1 << 20
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)
    found = [r.n for r in spark.range(40, numPartitions=1).selectExpr(f"repeat('x', {size}) t").mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 40 * size and max(found) <= BATCH_BYTES + 2 * size
