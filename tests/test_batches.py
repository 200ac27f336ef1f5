import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.functions import text as T
from spanloom.sources import logs


def test_parsed_lines_go_back_in_small_batches(spark):
    arrow = to_arrow_schema(spark.createDataFrame([], "source_file string, file_ord int, line_no bigint, " + logs.EXCHANGE).schema)
    line = lambda n: json.dumps({"request": {"messages": [{"role": "user", "content": "x" * n}]}, "response": {"message": {"role": "assistant", "content": "y"}}})
    values = [*[line(10)] * 2500, *[line(400_000)] * 9, "{", None, " "]
    batch = pa.RecordBatch.from_pydict({"source_file": ["f"] * len(values), "file_ord": pa.array([0] * len(values), pa.int32()), "line_no": [5] * len(values), "value": values})
    got = [*logs._parsed(iter([batch, batch.slice(0, 0)]), "auto", True, arrow)]
    assert [b.num_rows for b in got[:2]] == [1000, 1000] and max(b.num_rows for b in got) == 1000 and len(got) >= 5
    assert [n for b in got for n in b.column(2).to_pylist()] == [*range(5, 5 + 2510)]
    assert got[-1].column(got[-1].schema.get_field_index("skip_reason")).to_pylist()[-1] == "malformed"


def test_norm_args_of_long_short_and_no_texts(spark):
    said = ['{"b": 1,  "a": "x  y"}', None, "z " * 400, " p  2024-01-02 ", *[f"k  {n % 7}" for n in range(300)]]
    got = spark.createDataFrame([*enumerate(said)], "n int, t string").coalesce(1).select("n", T.norm_args(F.col("t")).alias("t")).orderBy("n").collect()
    assert [r.t for r in got] == ['{"a":"x y","b":1}', None, ("z " * 400).strip(), "p <ts>", *[f"k {n % 7}" for n in range(300)]]
