"""Exports by layout: CSV and Parquet, units in headers and metadata."""

from __future__ import annotations

import json

import pyarrow.parquet as pq
import pytest

from seriespan.sources import export

SAMPLES = "log_id long, channel_id string, seq long, t_ms long, v double"
CHANNELS = "log_id long, channel_id string, name string, dimension string, unit string, cls string, reference_kpa double, reason string"


def data(spark, n=30):
    rows = [(x, c, i, i * 10, 300.0 + i) for x in range(6) for c in "abz" for i in range(n)] + [(0, "a", 0, 0, 999.0), (1, "a", 3, 30, None)]
    channels = []
    for x in range(6):
        channels.append((x, "a", "CLT", "temperature", "degC" if x % 2 else "K", "point", None, None))
        if x < 5:
            channels.append((x, "b", "a, \"b\"", "pressure", "kPa", "point", 100.0, "no_unit" if x == 4 else None))
    return spark.createDataFrame(rows, SAMPLES).repartition(3), spark.createDataFrame(channels, CHANNELS)


def test_parquet(spark, tmp_path):
    s, channels = data(spark)
    files = export.export_layouts(s, channels, str(tmp_path / "out"), "parquet", 7).collect()
    # even, odd, raw pressure, and a log without pressure
    assert len({f.layout for f in files}) == 4 and sum(f.rows for f in files) == 6 * 30
    seen = {}
    for f in files:
        table = pq.ParquetFile(f.file.removeprefix("file:")).read()
        units = json.loads(table.schema.metadata[export.UNIT_KEY.encode()])
        assert table.num_rows == f.rows and list(units) == table.column_names[3:]
        for r in table.to_pylist():
            seen[(r["log_id"], r["seq"])] = (r, units)
    row, units = seen[("2", 5)]
    assert row == {"log_id": "2", "seq": 5, "t_ms": 50, "CLT [K]": 305.0, 'a, "b" [kPa (rel)]': 205.0} and units["CLT [K]"]["unit"] == "K"
    assert abs(seen[("3", 5)][0]["CLT [degC]"] - 31.85) < 1e-9 and seen[("4", 5)][0]['a, "b" [raw]'] == 305.0
    assert seen[("0", 0)][0]["CLT [K]"] == 999.0 and len(seen[("5", 1)][0]) == 4
    assert seen[("1", 3)][0]["CLT [degC]"] is not None


def test_csv(spark, tmp_path):
    s, channels = data(spark, 3)
    files = export.export_layouts(s, channels, str(tmp_path / "out")).collect()
    text = [open(f.file.removeprefix("file:")).read() for f in files]
    assert any(t.startswith('"log_id","seq","t_ms","CLT [K]","a, ""b"" [kPa (rel)]"') for t in text)
    assert sum(len(t.splitlines()) - 1 for t in text) == 19  # and the row without a value


def test_empty(spark, tmp_path):
    s, channels = data(spark)
    assert export.export_layouts(s.limit(0), channels, str(tmp_path / "a")).count() == 0
    assert export.export_layouts(s, channels.limit(0), str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        export.export_layouts(s, channels, str(tmp_path / "c"), "xls")
