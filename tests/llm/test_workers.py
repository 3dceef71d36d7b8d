"""What the operators leave in Python workers, which executors keep."""

import pyarrow as pa
import pytest

from jobstrata.llm import arrays, packing
from jobstrata.llm.queries import WORD_MERGES


class Rows:
    """Stands for a frame and keeps the function that maps its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("batches", [1, 3])
def test_packing_gives_memory_back_after_each_piece(spark, monkeypatch, batches):
    given = []
    monkeypatch.setattr(arrays, "release", lambda: given.append(1))
    text = "some words here " * (arrays.PIECE // 16)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text, text + "more"]})
    assert sum(len(out) for out in packing.windows(Rows(), WORD_MERGES).run([batch] * batches)) > batches
    assert len(given) == 2 * batches
