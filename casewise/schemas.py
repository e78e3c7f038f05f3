"""Fixed output schemas of the library."""

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_uid", T.StringType()),
        T.StructField("evidence_id", T.LongType()),
        T.StructField("case_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ts_inferred", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("raw_data", T.VariantType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("confidence_score", T.DoubleType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

NORMALIZED_EVENT = T.StructType(
    [
        T.StructField("event_uid", T.StringType()),
        T.StructField("case_id", T.LongType()),
        T.StructField("evidence_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("device_name", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("process_id", T.StringType()),
        T.StructField("parent_process", T.StringType()),
        T.StructField("command_line", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("registry_key", T.StringType()),
        T.StructField("network_protocol", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("parser_source", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("raw_event_reference", T.VariantType()),
        T.StructField("normalized", T.BooleanType()),
    ]
)

NODE = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("node_label", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("edge_id", T.StringType()),
        T.StructField("src_id", T.StringType()),
        T.StructField("dst_id", T.StringType()),
        T.StructField("src_label", T.StringType()),
        T.StructField("dst_label", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)

FACT = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("fact_id", T.StringType()),
        T.StructField("fact_type", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
