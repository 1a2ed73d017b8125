"""Folds against plain Python, and streams against batches."""

import random

from pyspark.sql import functions as F

from threatloom.operators import sessions
from threatloom.operators.requests import check_requests
from threatloom.operators.transactions import check_transactions
from threatloom.streaming import streams

SCRIPT = ["tell me about security", "great, now hack it", "okay so bypass the password", "now that works, jailbreak and inject it", "step 5: inject a reverse shell"]


def messages(spark):
    r = random.Random(1)
    rows = [("a", k, 60 * k, t) for k, t in enumerate(SCRIPT)] + [("b", k, 30 * k, r.choice(SCRIPT + ["hello", "thanks"])) for k in range(40)] + [(None, 1, 5, None)]
    return rows, spark.createDataFrame(rows, "session_id string, prompt_id long, t int, text string").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def plain_scores(text):
    low = (text or "").lower()
    return sum(w for k, w in sessions.TOPICS.items() if k in low)


def test_escalation(spark):
    import re

    rows, df = messages(spark)
    got = {(r["session_id"], r["prompt_id"]): (round(r["cumulative"], 6), r["transitions"], r["level"]) for r in sessions.escalation(df).collect()}
    want = {}
    for name in ("a", "b", None):
        total, moves, last, scores = 0.0, 0, None, []
        for s, k, t, text in sorted((x for x in rows if x[0] == name), key=lambda x: (x[2], x[1])):
            score = plain_scores(text)
            if re.search(sessions.TRANSITION.source, text or "", re.I):
                moves += 1
                score *= 1.5
            if last is not None:
                total *= max(0.5, 1 - (t - last) / 60 * 0.05)
            total, last = total + score, t
            scores.append(score)
            level = None
            if len(scores) >= 3 and total >= 12 and scores[-1] >= scores[-2] >= scores[-3] and moves >= 2:
                level = "high" if total >= 20 else "medium"
            want[s, k] = (round(total, 6), moves, level)
    assert got == want
    assert got["a", 0][2] is None and got["a", 4][2] is not None


def test_escalation_stream(spark, tmp_path):
    _, df = messages(spark)
    df = df.where("session_id IS NOT NULL")
    df.write.parquet(f"{tmp_path}/in")
    stream = streams.escalation(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["session_id"], r["prompt_id"], round(r["cumulative"], 6), r["transitions"], r["level"] or "")
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(key, sessions.escalation(df).collect()))


def test_anomaly(spark):
    rows = [("s", 1, 0, "record", "prompt_injection", "critical", 1.0), ("s", 2, 1, "record", "tool_exploitation", "high", 1.0), ("s", 3, 2, "check", None, None, None)]
    rows += [("s", 4 + k, 10 + k, "record", "x", ("low", "high")[k % 2], 0.1) for k in range(8)] + [("s", 20, 1000, "check", None, None, None), ("t", 1, 0, "check", None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, event_id long, t int, kind string, category string, level string, confidence double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r["session_id"], r["event_id"]): r for r in sessions.anomaly(df).collect()}
    assert got["s", 3]["found"] == "AD-CHAIN:injection and tools,AD-SCORE"
    assert abs(got["s", 3]["score"] - 76.0) < 1e-9
    assert got["s", 20]["found"].startswith("AD-ALT") and "CHAIN" not in got["s", 20]["found"]
    assert got["t", 1]["score"] == 0 and got["t", 1]["risk"] == "none"
    last = {r["session_id"]: r["n_events"] for r in sessions.latest_risk(sessions.anomaly(df)).collect()}
    assert last == {"s": 12, "t": 1}


def test_requests(spark):
    rows = [(k, k, "/admin/x", "ip", 10, None, None) for k in range(12)] + [(50, 5, "/open", "ip", 60000, {"x": "é", "cookie": "é"}, "é" * 60), (51, 6, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "req_id long, t int, path string, client_ip string, content_length int, headers map<string,string>, body string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["req_id"]: [d["signature_id"] for d in r["detections"]] for r in check_requests(df).collect()}
    assert got[9] == [] and got[10] == ["PM-RATE"] and got[50] == ["PM-SIZE", "PM-HDR", "PM-UNI"] and got[51] == []


def test_transactions(spark):
    tx = spark.createDataFrame([(1, 100, "0xA", 5.0, None, None), (2, 130, "0xB", 600.0, None, "approve(address,uint256)"), (3, 5000, "0xBAD", 5.0, "0x" + "f" * 64, None), (4, 9000, None, None, None, None)], "tx_id long, t int, to_address string, amount_usd double, contract_data string, function_sig string").withColumn("ts", F.timestamp_seconds("t")).withColumn("tx_type", F.lit("send"))
    ok = spark.createDataFrame([(110, 450.0)], "t int, amount_usd double").withColumn("ts", F.timestamp_seconds("t"))
    lists = [spark.createDataFrame([(a,)], "address string") for a in ("0xbad", "0xb")]
    got = {r["tx_id"]: ([d["signature_id"] for d in r["detections"]], r["verdict"]) for r in check_transactions(tx.withColumn("account", F.lit(1)), ok.withColumn("account", F.lit(1)), *lists, "account").collect()}
    assert got[1] == (["WF-NEWADDR"], "challenge")
    assert got[2] == (["WF-COOL", "WF-TXLIMIT", "WF-HOURLIMIT", "WF-FUNC"], "challenge")
    assert got[3] == (["WF-BLOCKLIST", "WF-UNLIMITED"], "challenge")
    assert got[4] == (["WF-APPROVE"], "challenge")
