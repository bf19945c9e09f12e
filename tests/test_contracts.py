"""Slots that are found by id or by tag, and what moves to evaluate them."""

import re

from stratadoc.operators import contracts as C

SLOT = "pair_id int, slot_id string, required boolean, tag string, story string, part string, paragraph int, occurrence int, start int, stop int, left_anchor string, right_anchor string, field_id string, content_type string, style map<string,string>"
CONTROL = "pair_id int, control_no int, tag string, alias string, story string, part string, paragraph int, start int, stop int, placeholder boolean, style map<string,string>"
TEXT = "pair_id int, story string, part string, paragraph int, text string"
PLAIN = {"font.size_pt": "12"}


def test_slots_by_id_and_tag(spark):
    def slot(name, tag, at, left="a:", right=":b"):
        return 1, name, True, tag, "body", "p", at, None, 2, 4, left, right, "f", "text", PLAIN

    def control(no, tag, at):
        return 1, no, tag, "f", "body", "p", at, 2, 4, False, PLAIN

    gold = [slot("s1", "t1", 1), slot("s2", "t2", 2), slot("s3", "t3", 3), slot("s4", "t4", 4), slot("s5", None, 5), slot("s6", "t6", 6), slot("s7", "t7", 7), slot("s8", "t8", 8)]
    actual = [slot("s1", "t1", 1), slot("x2", "t2", 2), slot("x3", "t3", 3), slot("y3", "t3", 3), slot("x5", None, 5), slot("s6", "t6", 6), slot("s6", "u6", 6), slot("s7", "t7", 7), slot("s8", "t8", 8, right="b")]
    texts = [(1, "body", "p", at, "a:xx:b") for at in range(1, 9)]
    frame = spark.createDataFrame
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = C.evaluate_slots(
            frame(gold, SLOT), frame(actual, SLOT), frame([control(k, f"t{k}", k) for k in range(1, 9)], CONTROL), frame([control(k, f"t{k}", k) for k in range(1, 9)] + [control(17, "t7", 7)], CONTROL),
            frame(texts, TEXT), frame(texts, TEXT), frame([("f", "text")], "field_id string, content_type string"),
        )
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        got = {}
        for r in df.collect():
            got.setdefault(r.slot_id, []).append((r.check, r.status, r.code))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    good = [(c, "PASS", None) for c in ("boundary", "field_id", "inventory", "location", "value_style")]
    bad = lambda code: sorted([("inventory", "FAIL", code)] + [("prerequisite", "FAIL", "required_slot_prerequisite_missing")] * 3)
    extra = [("inventory.extra", "FAIL", "extra_slot")]
    want = {"s1": good, "s2": good, "s3": bad(C.MISMATCH), "s4": bad("required_slot_missing"), "s5": good, "s6": bad(C.MISMATCH), "s7": bad(C.MISMATCH), "s8": [("boundary", "FAIL", "slot_overlaps_protected"), *good[1:]]}
    want |= {x: extra for x in ("x2", "x3", "y3", "x5")} | {"t4": [("inventory.broken", "FAIL", C.MISMATCH)]}
    want |= {"t5": [("inventory.broken", "FAIL", C.MISMATCH)]}
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    # anchors and spans meet their texts on one side; what moves on is what they gave
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert moved and not [x for x in moved if "slot_id#" in x and "left_anchor#" in x]
