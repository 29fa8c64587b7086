"""Raw records taken apart: numbers of any width against Python's, ids, short records, and what the plan is made of."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tracelake import queries as catalogue
from tracelake.functions import scalars as S
from tracelake.operators import align

BODIES = [bytes(range(1, 9)), b"\xff" * 8, b"\0" * 8, b"\0" * 7 + b"\x80", b"\x80" + b"\0" * 7, b"\x01\x02\x03", bytes(range(248, 256)), b"abcdefghij"]


@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize("width", range(1, 9))
def test_numbers_of_any_width(spark, width, little):
    df = spark.createDataFrame([(bytearray(b),) for b in BODIES], "b binary")
    got = [r.v for r in df.select(S.unsigned(F.col("b"), 0, width, little).alias("v")).collect()]
    assert [int(v) for v in got] == [int.from_bytes(b[:width], "little" if little else "big") for b in BODIES]


def test_ids_and_short_records(spark):
    rows = [b"\x01\x00a", b"\x02\x01b", b"\x01\x01c", b"\x01", b"", b"\x02\x01"]
    df = spark.createDataFrame([(bytearray(b),) for b in rows], "r binary")
    own = {"x": F.decode("body", "UTF-8")}
    got = align.demultiplex(df, "r", {1: own, 258: own, 7: own, 1 << 20: own}, 2)
    assert {i: sorted(r.x for r in t.collect()) for i, t in got.items()} == {1: ["a"], 258: ["", "b"], 7: [], 1 << 20: []}


def test_no_text_is_cut_for_each_byte(spark, sf):
    """Ids are compared as bytes, and numbers are turned round as numbers: cutting texts byte by byte took most of the time."""
    plan = catalogue.queries()["demultiplex_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(hex(" not in plan and "substring(lpad(" not in plan
