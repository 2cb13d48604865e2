import os

import pytest

from newsloom.llm import tokenizers
from newsloom.llm.queries import llm

COLUMNS = {
    "p1_found": {"src": "string", "row_id": "bigint", "language": "string"}, "p3_found": {"record_id": "bigint", "line_no": "bigint"}, "p4_found": {"src": "string", "row_id": "bigint", "para_key": "string"},
    "p5_found": {"src": "string", "row_id": "bigint"}, "p6_found": {"src": "string", "id_a": "bigint", "id_b": "bigint"}, "p7_found": {"id_a": "bigint", "id_b": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(llm.queries))
def test_runs(spark, folder, name):
    if name[:2] in ("p8", "p9") and not os.path.exists(tokenizers.FOLDER):
        pytest.skip("no tokenizers here")
    df = llm.queries[name](spark, folder)
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
