"""The given tables seen as the inputs of the operators.

The test tables hold no packets; these views give `events`, `embeddings`,
`lineitem`, `documents` and `labels` the same columns (see FIXTURES.md).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 432_000  # seconds; five days, about five packets per flow
SHORT_WINDOW = 21_600  # six hours, for history operators
TICK = 3_600  # one hour, stands in for one second in per-second reports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times carry no zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("capture_id"),
        F.col("event_id").alias("frame_number"),
        (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("ts"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), (k % 4).cast("string")).alias("dst_ip"),
        (1000 + F.col("user_id") % 3).cast("int").alias("src_port"),
        (80 + k % 3).cast("int").alias("dst_port"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "tcp").otherwise("udp").alias("protocol"),
        F.greatest(F.lit(1), F.least(F.lit(1500), F.ceil(F.col("value") * 10))).cast("int").alias("wire_length"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("binary_label"),
    )


PACKETS_SQL = """
SELECT 'c' || CAST(CAST(floor((day(ts) - 1) / 10) AS INT) AS VARCHAR) AS capture_id,
       event_id AS frame_number,
       CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS ts,
       '10.0.0.' || CAST(user_id % 4 AS VARCHAR) AS src_ip,
       '10.0.0.' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 AS VARCHAR) AS dst_ip,
       CAST(1000 + user_id % 3 AS INT) AS src_port,
       CAST(80 + CAST(json_extract_string(props, '$.k') AS INT) % 3 AS INT) AS dst_port,
       CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'tcp' ELSE 'udp' END AS protocol,
       CAST(greatest(1, least(1500, ceil(value * 10))) AS INT) AS wire_length,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS binary_label
FROM events
"""


def embedding_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that already carry an embedding, an assignment row and a local score."""
    v = [F.get("embedding", i).cast("double") for i in range(64)]
    raised = [F.exp(v[i]) for i in range(4)]
    total = raised[0] + raised[1] + raised[2] + raised[3]
    vid = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vid.alias("row_id"),
        F.concat(F.lit("c"), (vid % 2).cast("string")).alias("capture_id"),
        F.floor(vid / 50).cast("long").alias("window_index"),
        F.concat(F.lit("n"), (vid % 7).cast("string")).alias("endpoint_a_ip"),
        F.concat(F.lit("n"), F.col("label").cast("string")).alias("endpoint_b_ip"),
        F.col("label").alias("mode_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.array(*[r / total for r in raised]).alias("assignment"),
        (vid % 11).cast("double").alias("local_score"),
        (1 + vid % 5).cast("long").alias("packet_count"),
        (60 + 10 * (vid % 13)).cast("long").alias("byte_count"),
    )


EMBEDDING_FLOWS_SQL = """
SELECT vec_id AS row_id,
       'c' || CAST(vec_id % 2 AS VARCHAR) AS capture_id,
       CAST(floor(vec_id / 50) AS BIGINT) AS window_index,
       'n' || CAST(vec_id % 7 AS VARCHAR) AS endpoint_a_ip,
       'n' || CAST(label AS VARCHAR) AS endpoint_b_ip,
       label AS mode_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding,
       list_transform([1, 2, 3, 4], lambda i: exp(CAST(embedding[i] AS DOUBLE))
         / (exp(CAST(embedding[1] AS DOUBLE)) + exp(CAST(embedding[2] AS DOUBLE))
            + exp(CAST(embedding[3] AS DOUBLE)) + exp(CAST(embedding[4] AS DOUBLE)))) AS assignment,
       CAST(vec_id % 11 AS DOUBLE) AS local_score,
       CAST(1 + vec_id % 5 AS BIGINT) AS packet_count,
       CAST(60 + 10 * (vec_id % 13) AS BIGINT) AS byte_count
FROM embeddings
"""


def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties: fifty quantities over all line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("dataset"),
        F.col("l_quantity").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("binary_label"),
    )


TIED_SCORES_SQL = """
SELECT l_linestatus AS dataset, l_quantity AS score,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS binary_label
FROM lineitem
"""


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with few ties: document length against the toxic label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset"), "score",
        F.col("toxic").alias("binary_label"),
    )


DOCUMENT_SCORES_SQL = """
SELECT d.doc_id AS row_id, d.lang AS dataset, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS binary_label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as directed contacts; early ship dates are the benign part."""
    host = lambda c: F.concat(F.lit("h"), (F.col(c) % 20).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        host("l_suppkey").alias("src_ip"), host("l_partkey").alias("dst_ip"),
        F.col("l_returnflag").alias("protocol"),
        F.col("l_linenumber").alias("src_port"), (F.col("l_orderkey") % 5).cast("int").alias("dst_port"),
        (F.col("l_linestatus") == "F").alias("benign"),
    )


RELATIONS_SQL = """
SELECT l_orderkey AS order_id, l_linenumber AS line,
       'h' || CAST(l_suppkey % 20 AS VARCHAR) AS src_ip, 'h' || CAST(l_partkey % 20 AS VARCHAR) AS dst_ip,
       l_returnflag AS protocol, l_linenumber AS src_port, CAST(l_orderkey % 5 AS INT) AS dst_port,
       (l_linestatus = 'F') AS benign
FROM lineitem
"""
