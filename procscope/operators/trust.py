"""Which trusted program an executable is, by file identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procscope.operators.scan import END, over


def binding_periods(trusted: DataFrame) -> DataFrame:
    """Validity of each binding of a program to a file: until the program's next binding."""
    key = ["host", "name", "path"]
    return trusted.selectExpr(
        "*", f"coalesce(lead(valid_from) {over(key, 'valid_from')}, {END}L) AS valid_to"
    )


def resolve(execs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Add ``exe_trusted`` to exec rows (host, seq, filename, exe_dev, exe_ino).

    A program is recognised by the (device, inode) in force at that moment, or, where the two sides
    disagree about the device, by a tracked path whose inode is the one that ran. Inode 0 is unknown
    and matches nothing. The binding table has tens of rows per host; AQE picks the join by size.
    """
    b = binding_periods(trusted)
    now = "valid_from <= seq AND seq < valid_to"
    live = execs.filter("exe_ino <> 0").select("host", "seq", "filename", "exe_dev", "exe_ino")
    by_id = (
        live.join(
            b.selectExpr("host", "dev AS exe_dev", "ino AS exe_ino", "name", "valid_from", "valid_to"),
            ["host", "exe_dev", "exe_ino"],
        )
        .filter(now)
        .groupBy("host", "seq")
        .agg(F.expr("min(name) AS by_id"))
    )
    paths = b.selectExpr(
        "host", "explode(array_distinct(array(path, real_path))) AS filename", "ino AS exe_ino",
        "name", "valid_from", "valid_to",
    )
    by_path = (
        live.join(paths, ["host", "filename", "exe_ino"])
        .filter(now)
        .groupBy("host", "seq")
        .agg(F.expr("min(name) AS by_path"))
    )
    return (
        execs.join(by_id, ["host", "seq"], "left")
        .join(by_path, ["host", "seq"], "left")
        .selectExpr(
            *[c for c in execs.columns if c != "exe_trusted"],
            "coalesce(by_id, by_path, '') AS exe_trusted",
        )
    )
