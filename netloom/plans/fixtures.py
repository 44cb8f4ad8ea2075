"""Inputs derived from the benchmark tables; the same SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
_DUCK_US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"

TEXTS = {
    "packets": """
SELECT seq, ts_us, user_id,
       CASE WHEN c2s THEN client ELSE '192.168.100.10' END AS src_ip,
       CASE WHEN c2s THEN '192.168.100.10' ELSE client END AS dst_ip,
       CASE WHEN c2s THEN cport ELSE 80 END AS src_port,
       CASE WHEN c2s THEN 80 ELSE cport END AS dst_port,
       protocol,
       CASE WHEN protocol = 'UDP' THEN 0 ELSE flags END AS flags,
       CASE WHEN protocol = 'UDP' OR flags IN (24, 48) THEN len ELSE 0 END AS pkt_len,
       CASE WHEN protocol = 'UDP' THEN 8 ELSE hdr END AS header_len,
       CASE WHEN protocol = 'UDP' THEN 0 ELSE win END AS win_size
FROM (SELECT event_id AS seq,
             CAST(floor([us] / 20000) AS BIGINT) AS ts_us,
             user_id,
             event_id % 3 <> 0 AS c2s,
             concat('10.0.', CAST(user_id % 7 AS VARCHAR(20)), '.', CAST(user_id AS VARCHAR(20))) AS client,
             CAST(40000 + user_id AS BIGINT) AS cport,
             CASE WHEN user_id % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
             CASE WHEN event_type = 'signup' THEN 2
                  WHEN event_type = 'view' THEN 24
                  WHEN event_type = 'click' THEN 16
                  WHEN event_type = 'purchase' THEN 17
                  WHEN value > 60 THEN 20
                  ELSE 48 END AS flags,
             CAST(floor(value) AS BIGINT) AS len,
             CAST(20 + 4 * (event_id % 6) AS BIGINT) AS hdr,
             CAST(1000 + (event_id * 37) % 60000 AS BIGINT) AS win
      FROM [events]) e""",
    "flows": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS flow_id,
       l_orderkey * 7 + l_linenumber * 131 + l_partkey * 17 + l_suppkey * 3 AS h,
       CASE WHEN l_orderkey % 11 = 0 THEN 'lab' ELSE 'cic' END AS domain,
       l_orderkey % 50 AS campaign_id,
       l_orderkey AS connection_id,
       l_linenumber AS snapshot_no,
       l_quantity AS f_qty,
       l_extendedprice AS f_price,
       l_extendedprice * 2 + 1 AS f_price2,
       l_discount AS f_disc,
       CASE WHEN l_partkey % 97 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN l_partkey % 89 = 0 THEN CAST('Infinity' AS DOUBLE)
            WHEN l_partkey % 83 = 0 THEN NULL
            ELSE l_tax END AS f_tax,
       CAST(1 AS DOUBLE) AS f_const,
       CASE WHEN k = 0 THEN 'Botnet' WHEN k = 1 THEN 'Bruteforce'
            WHEN k BETWEEN 2 AND 6 THEN 'DDoS' WHEN k IN (7, 8) THEN 'DoS'
            WHEN k = 9 THEN 'Infiltration' WHEN k = 10 THEN ' Webattack '
            WHEN k = 11 THEN 'Portscan' ELSE 'Benign' END AS class_label
FROM (SELECT *, (l_partkey * 7 + l_suppkey) % 40 AS k FROM [lineitem]) l""",
    "scores": """
SELECT flow_id, h, domain, campaign_id, connection_id, snapshot_no, truth, p_attack,
       w0 * (CASE WHEN truth = 'Benign' THEN 8 ELSE 1 END) AS w0,
       w1 * (CASE WHEN truth = 'Botnet' THEN 8 ELSE 1 END) AS w1,
       w2 * (CASE WHEN truth = 'Bruteforce' THEN 8 ELSE 1 END) AS w2,
       w3 * (CASE WHEN truth = 'DDoS' THEN 8 ELSE 1 END) AS w3,
       w4 * (CASE WHEN truth = 'DoS' THEN 8 ELSE 1 END) AS w4,
       w5 * (CASE WHEN truth = 'Other Attack' THEN 8 ELSE 1 END) AS w5,
       w6 * (CASE WHEN truth = 'Portscan' THEN 8 ELSE 1 END) AS w6
FROM (SELECT flow_id, h, domain, campaign_id, connection_id, snapshot_no,
             CASE WHEN class_label IN ('Infiltration', ' Webattack ') THEN 'Other Attack'
                  ELSE class_label END AS truth,
             CAST(h * 31 % 1000 AS DOUBLE) / 1000.0 AS p_attack,
             1 + (h * 3) % 97 AS w0, 1 + (h * 5) % 97 AS w1,
             1 + (h * 7) % 89 AS w2, 1 + (h * 11) % 83 AS w3,
             1 + (h * 13) % 79 AS w4, 1 + (h * 17) % 73 AS w5,
             1 + (h * 19) % 71 AS w6
      FROM [flows]) f""",
    "alerts": """
SELECT flow_id AS id,
       concat('10.1.0.', CAST(campaign_id AS VARCHAR(20))) AS source_ip,
       '192.168.100.10' AS destination_ip,
       CASE WHEN h % 101 = 0 THEN NULL
            WHEN h % 13 = 0 THEN 'Web Attack'
            WHEN truth = 'Benign' THEN 'Normal Traffic' ELSE truth END AS attack_type,
       CASE WHEN h % 7 = 0 OR h % 101 = 0 THEN NULL
            WHEN truth = 'Benign' THEN 'Normal Traffic' ELSE truth END AS model_attack_type,
       CASE WHEN h % 19 = 0 THEN NULL ELSE 1 + h % 60 END AS latency_ms,
       CAST(h % 97 AS DOUBLE) / 97.0 AS confidence,
       CASE WHEN h % 7 = 0 THEN NULL ELSE CAST(h % 89 AS DOUBLE) / 89.0 END AS model_confidence
FROM [scores]""",
    "campaign_events": """
SELECT user_id AS campaign_id, event_id, event_id % 2 AS worker_id,
       concat('192.168.100.', CAST(67 + event_id % 2 * (user_id % 3) AS VARCHAR(20))) AS source_ip,
       event_type AS action,
       CAST(floor([us] / 20000) AS BIGINT) AS started_us,
       CAST(floor([us] / 20000) AS BIGINT) + 500000 AS ended_us,
       event_type <> 'error' AS success,
       CAST(floor(value) AS BIGINT) AS response_bytes,
       1 + event_id % 3 AS reserved_actions,
       CASE WHEN event_id % 5 = 0 THEN 1 ELSE 1 + event_id % 3 END AS actions_completed,
       40 + event_id % 90 AS outbound_bytes,
       concat('reply ', CAST(event_id AS VARCHAR(20)), repeat(' more', CAST(event_id % 40 AS INTEGER))) AS detail
FROM [events]""",
}
_PARENT = {"packets": "events", "flows": "lineitem", "scores": "flows", "alerts": "scores",
           "campaign_events": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table (parquet) or a derived input, as a lazy DataFrame."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parent = _PARENT[name]
    text = TEXTS[name].replace("[us]", _SPARK_US).replace(f"[{parent}]", "{parent}")
    return spark.sql(text, parent=table(spark, sf_dir, parent))


def duck(*names: str) -> str:
    """``WITH`` clauses (without the keyword) that define derived inputs in DuckDB."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in TEXTS and name not in needed:
            need(_PARENT[name])
            needed.append(name)

    for name in names:
        need(name)
    return ",\n".join(
        f"{name} AS ({TEXTS[name].replace('[us]', _DUCK_US).replace(f'[{_PARENT[name]}]', _PARENT[name])})"
        for name in needed)
