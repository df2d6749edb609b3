"""Files of fixed-size binary records, possibly zstd-compressed, as a Python data source.

A file is a prefix of eight bytes (three of magic, one of version, four of
metadata length, little-endian), metadata to skip, and records of one layout,
each of which begins with its own length in words of four bytes. A compressed
file may have several frames. A file of another magic, version or record length
and one that ends within a record are errors, as rows would be lost unseen.
Files are the partitions; records come out as arrow batches. Options: layout (a
name of LAYOUTS), path (a file or folder).
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantloom.functions.market import fixed_point
from quantloom.operators.joins import interval

# Fields of the published record layouts, with their numpy types.
HEADER = [("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8")]
LAYOUTS = {
    "statistics": [*HEADER, ("ts_recv", "<u8"), ("ts_ref", "<u8"), ("price", "<i8"), ("quantity", "<i4"), ("sequence", "<u4"), ("ts_in_delta", "<i4"), ("stat_type", "<u2"), ("channel_id", "<u2"), ("update_action", "u1"), ("stat_flags", "u1"), ("_reserved", "V6")],
    "definition": [
        *HEADER, ("ts_recv", "<u8"), ("min_price_increment", "<i8"), ("display_factor", "<i8"), ("expiration", "<u8"), ("activation", "<u8"), ("_limits", "V24"), ("trading_reference_price", "<i8"), ("unit_of_measure_qty", "<i8"), ("_increments", "V20"),
        ("underlying_id", "<u4"), ("raw_instrument_id", "<u4"), ("_sizes", "V36"), ("contract_multiplier", "<i4"), ("_decay", "V16"), ("maturity_year", "<u2"), ("_decay_start", "V4"), ("currency", "S4"), ("settl_currency", "S4"), ("secsubtype", "S6"), ("raw_symbol", "S22"), ("group", "S21"), ("exchange", "S5"), ("asset", "S7"), ("cfi", "S7"),
        ("security_type", "S7"), ("unit_of_measure", "S31"), ("underlying", "S21"), ("strike_price_currency", "S4"), ("instrument_class", "S1"), ("_reserved4", "V2"), ("strike_price", "<i8"), ("_reserved5", "V6"), ("_display", "V7"), ("security_update_action", "S1"), ("maturity_month", "u1"), ("maturity_day", "u1"), ("maturity_week", "u1"), ("user_defined_instrument", "S1"), ("_rest", "V6"),
    ],
    "quotes": [*HEADER, ("price", "<i8"), ("size", "<u4"), ("action", "S1"), ("side", "S1"), ("flags", "u1"), ("depth", "u1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4"), ("bid_px", "<i8"), ("ask_px", "<i8"), ("bid_sz", "<u4"), ("ask_sz", "<u4"), ("bid_ct", "<u4"), ("ask_ct", "<u4")],
    "orders": [*HEADER, ("order_id", "<u8"), ("price", "<i8"), ("size", "<u4"), ("flags", "u1"), ("channel_id", "u1"), ("action", "S1"), ("side", "S1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4")],
}
# Fields that are no columns; those with an underscore are reserved or not used.
LEFT_OUT = {"length", "rtype", "publisher_id"}
# Magic and versions of the format.
MAGIC, VERSIONS = b"DBN", {1, 2, 3}
_SQL = {"u1": "int", "<u2": "int", "<u4": "bigint", "<u8": "bigint", "<i8": "bigint", "<i4": "int"}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def dtype(layout: str) -> np.dtype:
    """The numpy type of a layout's record."""
    return np.dtype(LAYOUTS[layout])


def fields(layout: str) -> list[tuple[str, str]]:
    """(column, SQL type) of a layout, without header bytes and padding."""
    return [(n, "string" if t[0] == "S" else _SQL[t]) for n, t in LAYOUTS[layout] if n not in LEFT_OUT and n[0] != "_"]


def pack(records: np.ndarray, compress: bool = True) -> bytes:
    """A file of records (used to write fixtures)."""
    records = records.copy()
    records["length"] = records.dtype.itemsize // 4
    raw = MAGIC + b"\x01" + struct.pack("<I", 0) + records.tobytes()
    if not compress:
        return raw
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


def unpack(raw: bytes, layout: str) -> np.ndarray:
    """The records of a file, of all its frames. A broken file is an error; an empty one has no records."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    if not raw:
        return np.empty(0, dtype(layout))
    if len(raw) < 8 or raw[:3] != MAGIC or raw[3] not in VERSIONS:
        raise ValueError("no record file of a known version")
    start, size = 8 + struct.unpack_from("<I", raw, 4)[0], dtype(layout).itemsize
    n, rest = divmod(len(raw) - start, size)
    if n < 0 or rest:
        raise ValueError("the file ends within a record")
    rows = np.frombuffer(raw, dtype(layout), n, start)
    if n and (rows["length"].astype(int) * 4 != size).any():
        raise ValueError(f"the records are not of the layout {layout}")
    return rows


def _text(v: np.ndarray) -> pa.Array:
    """Fixed-size byte strings as text, padding left out; each distinct value is decoded once."""
    values, at = np.unique(v, return_inverse=True)
    return pa.array([x.decode("latin-1") for x in values.tolist()], pa.string()).take(pa.array(at))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.layout = options["path"], options.get("layout", "quotes")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):  # files that every host sees under the same path
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if not f.startswith((".", "_"))]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            rows = unpack(f.read(), self.layout)
        for i in range(0, len(rows), 65_536):
            part = rows[i : i + 65_536]
            columns = []
            for name, kind in fields(self.layout):
                v = part[name]
                columns.append(_text(v) if kind == "string" else pa.array(v.astype("i8" if kind == "bigint" else "i4"), _ARROW[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields(self.layout)])


def order_events(orders: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Records of layout orders as an order feed: ts, ts_recv, seq, action, side, px, sz, order_id, instrument_id, in terms of receive time.

    A side other than A and B is null. symbols (instrument_id, symbol, start,
    end): adds the symbol valid when the event was received; events without one
    are dropped.
    """
    at = lambda c: F.timestamp_micros(F.expr(f"{c} DIV 1000"))
    out = orders.select(at("ts_event").alias("ts"), at("ts_recv").alias("ts_recv"), F.col("sequence").alias("seq"), F.upper("action").alias("action"), F.when(F.upper("side").isin("A", "B"), F.upper("side")).alias("side"), F.col("price").alias("px"), F.col("size").alias("sz"), "order_id", "instrument_id")
    return out if symbols is None else interval(out, symbols, "instrument_id", "ts_recv", "start", "end", ["symbol"])


def definitions(records: DataFrame) -> DataFrame:
    """Records of layout definition as a contract store: outright calls and puts only, one row per contract and activation, the latest definition of each.

    instrument_id, activation, expiry, strike, cp_flag (call, put), asset,
    underlying, underlying_id, raw_symbol, multiplier; undefined prices and
    times are null.
    """
    at = lambda c: F.when(F.col(c).between(1, 2**62), F.timestamp_micros(F.expr(f"{c} DIV 1000")))
    outright = records.where(F.col("instrument_class").isin("C", "P"))
    rows = outright.select(
        "instrument_id", at("activation").alias("activation"), "ts_recv", at("expiration").alias("expiry"), fixed_point(F.col("strike_price")).alias("strike"), F.when(F.col("instrument_class") == "C", "call").otherwise("put").alias("cp_flag"),
        "asset", "underlying", "underlying_id", "raw_symbol", F.when(F.col("contract_multiplier") != 2**31 - 1, F.col("contract_multiplier")).alias("multiplier"),
    )
    names = [c for c in rows.columns if c not in ("instrument_id", "activation", "ts_recv")]
    return rows.groupBy("instrument_id", "activation").agg(F.max(F.struct("ts_recv", *names)).alias("x")).select("instrument_id", "activation", *[f"x.{c}" for c in names])


class Records(DataSource):
    """spark.read.format("records").option("layout", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return ", ".join(f"{n} {k}" for n, k in fields(self.options.get("layout", "quotes")))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Records)
