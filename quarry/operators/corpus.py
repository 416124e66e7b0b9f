"""Synthetic machine text: telemetry, configuration and mixed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import padded
from quarry.functions.word64 import MMIX, MMIX_ADD, lcg_at
from quarry.operators.ordered import ranked

#: Seed and pools of the generated corpora (fixed values).
SEED = 0x243F6A8885A308D3
IPS = ["10.0.14.7", "192.168.3.44", "172.16.9.101", "10.0.14.22", "203.0.113.9"]
PATHS = ["/api/v2/users", "/api/v2/orders", "/static/js/app.bundle.js", "/health", "/api/v2/cart/items", "/img/logo.png"]
AGENTS = ["Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36", "curl/8.5.0", "python-requests/2.32.0"]
LEVELS = ["INFO", "INFO", "INFO", "WARN", "ERROR", "DEBUG"]
SERVICES = ["auth-service", "order-service", "cart-service", "payment-gateway"]
MESSAGES = ["request completed successfully", "cache miss, falling back to database", "connection pool exhausted, retrying", "token refreshed for session", "slow query detected, duration above threshold"]
SENSORS = ["temp_cpu", "temp_ambient", "fan_rpm", "volt_12", "power_w", "disk_io"]
HOSTS = ["node-a1", "node-a2", "node-b1", "node-b2", "node-c1"]


def _pick(pool: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, pool)), (i % len(pool)).cast("int"))


def draws(spark: SparkSession, n: int) -> DataFrame:
    """line_no, r: the draws that each line derives from."""
    return spark.range(n).select(F.col("id").alias("line_no"), F.shiftrightunsigned(lcg_at(SEED, MMIX, MMIX_ADD, F.col("id") + 1), 33).alias("r"))


def corpus(spark: SparkSession, n: int, mode: str) -> DataFrame:
    """line_no, text of n entries of mode csv, config or mixed.

    The clock is a running sum of steps and the request number a running count, both over ranges of lines.
    """
    r = F.col("r")
    rows = draws(spark, n).withColumn("step", 7 + r.bitwiseAND(F.lit(63))).withColumn("request", (r % 10 >= 4).cast("long"))
    rows = ranked(rows, ["line_no"], {"clock": "step", "requests": "request"})
    total = F.col("clock") + F.col("step")
    at = lambda shift: F.shiftright(r, shift)
    two = lambda v: padded(v.cast("long"), F.lit(2))
    # the clock gives up one whole second a line at most; steps are far below one, so that it never lags
    seconds = F.floor(total / 1000).cast("long")
    hms = F.concat(two(F.floor(seconds / 3600) % 24), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))
    stamp = F.concat(F.lit("2026-07-23T"), hms)
    ms = padded(total % 1000, F.lit(3))
    if mode == "csv":
        text = F.concat(stamp, F.lit("."), ms, F.lit("Z,"), _pick(HOSTS, r), F.lit(","), _pick(SENSORS, at(3)), F.lit(","), (20 + r % 60).cast("string"), F.lit("."), two(at(6) % 100), F.lit(",ok,"), (at(8) % 100000).cast("string"), F.lit("\n"))
    elif mode == "config":
        text = F.concat(F.lit("[service."), _pick(SERVICES, r), F.lit("]\nendpoint = https://"), _pick(HOSTS, at(2)), F.lit(".internal:8443"), _pick(PATHS, at(4)), F.lit("\ntimeout_ms = "), (100 * (1 + r % 40)).cast("string"), F.lit("\nretries = "), (1 + r % 5).cast("string"), F.lit("\ntls = true\nlog_level = "), _pick(LEVELS, at(6)), F.lit("\n\n"))
    elif mode == "mixed":
        number = padded(100000 + F.col("requests"), F.lit(7))
        status = F.when(r.bitwiseAND(F.lit(127)) < 120, "200").otherwise("500")
        access = F.concat(_pick(IPS, r), F.lit(" - - [23/Jul/2026:"), hms, F.lit(' +0000] "GET '), _pick(PATHS, at(3)), F.lit(' HTTP/1.1" '), status, F.lit(" "), (512 + r % 8192).cast("string"), F.lit(' "-" "'), _pick(AGENTS, at(7)), F.lit('"\n'))
        json = F.concat(F.lit('{"ts":"'), stamp, F.lit("."), ms, F.lit('Z","level":"'), _pick(LEVELS, at(2)), F.lit('","service":"'), _pick(SERVICES, at(5)), F.lit('","request_id":"req-'), number, F.lit('","message":"'), _pick(MESSAGES, at(9)), F.lit('","latency_ms":'), (1 + r % 900).cast("string"), F.lit("}\n"))
        xml = F.concat(F.lit('  <event id="'), number, F.lit('" ts="'), stamp, F.lit('"><service>'), _pick(SERVICES, r), F.lit("</service><level>"), _pick(LEVELS, at(4)), F.lit("</level><detail>"), _pick(MESSAGES, at(6)), F.lit("</detail></event>\n"))
        text = F.when(r % 10 < 4, access).when(r % 10 < 8, json).otherwise(xml)
    else:
        raise ValueError(f"no corpus {mode}")
    return rows.select("line_no", text.alias("text"))
