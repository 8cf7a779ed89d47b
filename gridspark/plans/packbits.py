"""Run-length packets (PackBits) of lines of bytes, as relations.

A line's bytes, in the order of their place, fall into islands of equal neighbours. Islands of three bytes and more are runs, cut into packets of
128; what lies between runs is one literal, cut the same way. A packet of n bytes is the control byte 257 - n and the byte, or n - 1 and the
bytes; what is left of a run behind its last whole packet is a packet too, of one byte if need be. Islands and packets come from windows over lines,
packets hold 128 bytes at most, and a line is put together from its packets only.

Bytes are taken as 0..255 (a null is 0, others are held within); places without a row take no byte; rows of one place stand in the order of their bytes; other
columns are ignored; an empty table has no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The shortest run, and the most bytes of a packet.
LEAST_RUN, MOST = 3, 128


def _hex(v: Column) -> Column:
    return F.lpad(F.hex(v), 2, "0")


def packets(rows: DataFrame, keys: list[str], place: str = "place", value: str = "value") -> DataFrame:
    """keys, start (bytes of the line before it), n, is_run, packed: the packets of each line."""
    byte = F.greatest(F.least(F.coalesce(F.col(value).cast("bigint"), F.lit(0)), F.lit(255)), F.lit(0))
    line = Window.partitionBy(*keys).orderBy("place", "byte")
    changes = F.coalesce(F.col("byte") != F.lag("byte").over(line), F.lit(True))
    px = rows.select(*keys, F.col(place).alias("place"), byte.alias("byte")).withColumns({"at": F.row_number().over(line) - 1, "island": changes.cast("int")})
    ordered = Window.partitionBy(*keys).orderBy("at")
    px = px.withColumn("head", F.col("island") == 1).withColumn("island", F.sum("island").over(ordered))
    px = px.withColumn("is_run", F.count("*").over(Window.partitionBy(*keys, "island")) >= LEAST_RUN)
    # a literal goes on over islands, a run is an island
    cut = F.col("head") & (F.col("is_run") | F.coalesce(F.lag("is_run").over(ordered), F.lit(True)))
    px = px.withColumn("segment", F.sum(cut.cast("int")).over(ordered))
    first = F.min("at").over(Window.partitionBy(*keys, "segment"))
    px = px.withColumn("part", F.floor((F.col("at") - first) / MOST))
    held = F.array_sort(F.collect_list(F.struct("at", "byte")))
    each = px.groupBy(*keys, "segment", "part", "is_run").agg(F.min("at").cast("bigint").alias("start"), F.count("*").alias("n"), held.alias("held"))
    run = F.concat(_hex((257 - F.col("n")) % 256), _hex(F.get("held", 0)["byte"]))
    literal = F.concat(_hex(F.col("n") - 1), F.array_join(F.transform("held", lambda h: _hex(h["byte"])), ""))
    return each.select(*keys, "start", "n", "is_run", F.unhex(F.when(F.col("is_run"), run).otherwise(literal)).alias("packed"))


def encode(rows: DataFrame, keys: list[str], place: str = "place", value: str = "value") -> DataFrame:
    """keys, n_bytes, packed: each line's packets one after the other."""
    ordered = F.array_sort(F.collect_list(F.struct("start", F.hex("packed").alias("packed"))))
    lines = packets(rows, keys, place, value).groupBy(*keys).agg(F.sum("n").alias("n_bytes"), ordered.alias("parts"))
    return lines.select(*keys, "n_bytes", F.unhex(F.array_join(F.transform("parts", lambda p: p["packed"]), "")).alias("packed"))


def unpacked(packed: bytes | None) -> bytes | None:
    """The bytes of a line's packets; control byte 128 is skipped; None for a packet that ends early."""
    if packed is None:
        return None
    out, i = bytearray(), 0
    while i < len(packed):
        control, i = packed[i], i + 1
        if control == 128:
            continue
        taken = control + 1 if control < 128 else 1
        if i + taken > len(packed):
            return None
        out += packed[i : i + taken] if control < 128 else packed[i : i + 1] * (257 - control)
        i += taken
    return bytes(out)


def decode(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, data: the bytes of each line's ``packed``; null where it is null or not whole. Any order of packets is read, not only what ``encode`` writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([unpacked(v) for v in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], data], [*keys, "data"])

    rows = lines.select(*keys, "packed")
    return rows.mapInArrow(run, "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + "data binary")
