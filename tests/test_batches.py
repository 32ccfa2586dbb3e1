"""Python code that makes objects of texts does so by bounded bytes, not by whole Arrow batches."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from corvina.functions import batches, providers
from corvina.sources import tsv


def test_slices_of_bounded_bytes():
    texts = ["x" * 400_000, None, "", "é" * 200_000, "y" * 3_000_000, "z", "w" * (1 << 20)]
    batch = pa.RecordBatch.from_pydict({"t": texts})
    got = [part["t"].to_pylist() for part in batches.text_slices(batch, "t")]
    assert sum(got, []) == texts and all(len(p) == 1 or sum(len((x or "").encode()) for x in p) <= batches.HELD_BYTES for p in got)
    assert len(got) == 4 and list(batches.text_slices(batch.slice(0, 0), "t")) == []


def test_captions_hold_few_pages():
    class Lengths:
        def caption(self, doc, markdown):
            return f"{doc}: {markdown and len(markdown)}"

    text = T.StructType([T.StructField("doc", T.StringType()), T.StructField("markdown", T.StringType())])
    run = providers.with_caption(SimpleNamespace(schema=text, mapInArrow=lambda f, schema: f), Lengths())
    batch = pa.RecordBatch.from_pydict({"doc": [f"d{i}" for i in range(1000)], "markdown": [None, *["x" * 10_000] * 999]})
    got = list(run(iter([batch])))
    assert max(b.num_rows for b in got) <= batches.HELD_BYTES // 10_000 + 1
    assert sum((b["caption"].to_pylist() for b in got), []) == ["d0: None", *[f"d{i}: 10000" for i in range(1, 1000)]]


def test_records_leave_by_bounded_bytes():
    """Records of 10,000 characters: batches of a MB, with their fields, not of 4,096 records."""
    lines = [f'{i}\t"{"x" * 10_000}"' for i in range(1000)]
    n = len(lines)
    batch = pa.RecordBatch.from_pydict({"path": ["p"] * n, "file": [1] * n, "block": [0] * n, "line": lines, "entry": [False] * n, "first": [0] * n})
    got = list(tsv._pieces(iter([batch])))
    assert max(sum(map(len, b["raw"].to_pylist())) for b in got) <= batches.HELD_BYTES + 11_000
    assert sum((b["raw"].to_pylist() for b in got), []) == lines
    assert sum((b["fields"].to_pylist() for b in got), []) == [[str(i), "x" * 10_000] for i in range(1000)]
