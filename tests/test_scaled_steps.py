"""Steps that were rewritten to scale: one pass over an order's lines, few state calls, no text written to search it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shipyard.functions.text import holds_text
from shipyard.plans import standins as SI
from shipyard.streaming.gate import Gate


def _tables(spark, d):
    day = datetime(1998, 1, 1)
    lines = [(1, 1, 10, 1, 1.0, 5.0, "N", day), (1, 2, 11, 2, 1.0, 5.0, "R", day), (1, 1, 11, 3, 1.0, 5.0, "N", day), (9, 1, 10, 1, 1.0, 5.0, "N", day)]
    names = "l_orderkey l_suppkey l_partkey l_linenumber l_quantity l_extendedprice l_returnflag l_shipdate"
    for name, rows, columns in (
            ("lineitem", lines, names), ("orders", [(1, 7, "O", "1-URGENT", day)], "o_orderkey o_custkey o_orderstatus o_orderpriority o_orderdate"),
            ("part", [(10, "red", "A"), (11, "blue", "B")], "p_partkey p_name p_brand"),
            ("supplier", [(1, "s1", 0), (2, "s2", 0)], "s_suppkey s_name s_nationkey"), ("nation", [(0, "X")], "n_nationkey n_name")):
        spark.createDataFrame(rows, columns.split()).write.parquet(f"{d}/{name}.parquet")


def test_messages_and_outcomes_read_the_lines_from_one_table(spark, tmp_path):
    _tables(spark, str(tmp_path))
    msgs, outcomes = SI.order_installations(spark, str(tmp_path))
    for df in (msgs, outcomes):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    (msg,) = msgs.select("msg_id", F.get_json_object("body", "$.list_server[0].app_list[1].version").alias("v")).collect()
    assert (msg.msg_id, msg.v) == ("1", "blue")
    # Outcomes of lines without an order are reported too.
    found = sorted((r.msg_id, r.phase_id, r.srv_pos, r.rec_pos, r.exit_status) for r in outcomes.collect())
    assert found == [("1", "10", 0, 0, 0), ("1", "10", 0, 1, 0), ("1", "10", 1, 0, 1), ("1", "2", 0, 0, 0), ("1", "2", 1, 0, 0),
                     ("9", "10", 0, 0, 0), ("9", "2", 0, 0, 0)]


class _State:
    def __init__(self, calls, value):
        self.calls, self.value = calls, value

    def __getattr__(self, name):
        def call(*value):
            self.calls.append(name)
            if name in ("put", "update"):
                self.value = value[0]
            return self.value
        return call


class _Handle:
    def __init__(self):
        self.calls = []

    def getListState(self, *_):  # noqa: N802
        return _State(self.calls, [])

    def getValueState(self, *_):  # noqa: N802
        return _State(self.calls, None)

    getMapState = getListState  # noqa: N815

    def registerTimer(self, ts):  # noqa: N802
        self.calls.append("timer")


class _Times:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 1_000


def test_state_calls_do_not_grow_with_rows():
    gate, handle = Gate(10_000_000), _Handle()
    gate.init(handle)
    gate.hash.value = (0, "", "h")
    gate.waiting.value = [(k, k % 2, str(k), f"copy{k}", True, "h", "{}") for k in range(400)]
    (out,) = gate.handleExpiredTimer(("c", 0), _Times(), None)
    assert set(out["status"]) == {"accepted"} and len(out) == 200
    assert len(handle.calls) < 10


def test_search_in_parsed_texts_is_that_of_the_written_document(spark):
    schema = "doc struct<a: array<struct<b: string, m: map<string, string>>>, n: bigint>"
    rows = [(None,), (([],  1),), (([("x secret", {})], 1),), (([None, (None, {"k": "secret"})], 1),), (([("plain", None)], None),)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(holds_text(F.col("doc"), df.schema["doc"].dataType, "secret").alias("x"),
                    F.coalesce(F.to_json("doc").contains("secret"), F.lit(False)).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [False, False, True, True, False]
