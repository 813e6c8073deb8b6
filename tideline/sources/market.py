"""A Python data source for market data: `spark.read.format("market_fixture")` over a folder of JSON fixtures.

No network is used. A live feed would be another reader of the same schemas; nothing raises for a missing symbol, the
result is empty and says so.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "bars": "symbol string, day date, open double, high double, low double, close double, volume bigint",
    "quote": "symbol string, price double, currency string, as_of string",
    "estimates": "symbol string, period string, eps double, low double, high double, analysts int",
    "notes": "symbol string, note string",
}


class MarketFixture(DataSource):
    """Options: path, kind (bars, quote, estimates or notes), symbols (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "market_fixture"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "bars")]

    def reader(self, schema) -> MarketReader:
        return MarketReader(self.options, [f.name for f in schema.fields])


class MarketReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.kind, self.columns = options["path"], options.get("kind", "bars"), columns
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]

    def partitions(self):
        return [InputPartition(s) for s in self.symbols] or [InputPartition(None)]

    def read(self, partition):
        from datetime import date

        symbol = partition.value
        files = [Path(self.path) / f"{symbol}.json"] if symbol else sorted(Path(self.path).glob("*.json"))
        for f in files:
            try:
                data = json.loads(f.read_text(encoding="utf-8"))
            except (OSError, ValueError):
                if self.kind == "notes":
                    yield (f.stem, "no data")
                continue
            for row in data.get(self.kind, []):
                row = {"symbol": f.stem, **row}
                yield tuple(date.fromisoformat(row[c]) if c == "day" and row.get(c) else row.get(c) for c in self.columns)
