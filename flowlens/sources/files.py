"""File sources: Parquet folders, CSV scenarios, JSON events, request payloads and synthetic scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import contracts

#: The scenario file's columns, in order (fixed format).
SCENARIO = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("traffic_group", T.StringType()), T.StructField("expected_prediction", T.StringType()), T.StructField("expected_severity", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("flow_duration_ms", "total_fwd_packets", "total_bwd_packets", "total_length_fwd_packets", "total_length_bwd_packets", "fwd_packet_length_max", "bwd_packet_length_max", "flow_bytes_s", "flow_packets_s", "syn_flag_count", "ack_flag_count", "rst_flag_count", "psh_flag_count", "unique_dst_ports", "same_srv_rate", "failed_login_attempts")),
    T.StructField("Binary_Label", T.IntegerType()), T.StructField("Attack_Type", T.StringType()),
])

PREDICTION = "prediction string, confidence double, model string, timestamp string, source_prediction string, window_size int"


def parquet_folder(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All Parquet files of a folder united by name, with source_file and record_id (position in the file); none is an error."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(path)
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise contracts.ContractError(f"no Parquet file in {path}") from e
        raise
    contracts.forbid_columns(df, ["source_file", "record_id"])
    return df.select(*(columns or df.columns), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("record_id"))


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The schema alone; no row is read."""
    return spark.read.parquet(path).columns


def scenario_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIO).option("header", True).csv(path)


def event_json(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """A JSON list of events; items that are not objects are dropped."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(path).dropna("all")


def _features(payloads: DataFrame, column: str) -> DataFrame:
    """payloads with v (the features, under their key or bare), its kind and, if it is an object, its values by name."""
    body = payloads.withColumn("__body", F.try_parse_json(column))
    body = body.withColumn("__v", F.expr("coalesce(try_variant_get(__body, '$.features', 'variant'), __body)")).withColumn("__kind", F.expr("coalesce(schema_of_variant(__v), '')"))
    return body.withColumn("__of", F.when(F.col("__kind").startswith("OBJECT"), F.expr("try_variant_get(__v, '$', 'map<string, variant>')"))).withColumn(
        "__columnar", F.expr("coalesce(size(__of) > 0 AND forall(map_values(__of), x -> schema_of_variant(x) LIKE 'ARRAY%'), false)")
    ).withColumn("__lengths", F.expr("CASE WHEN __columnar THEN transform(map_values(__of), x -> size(try_variant_get(x, '$', 'array<variant>'))) END"))


def payload_errors(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Request bodies that are refused, with error: neither object nor list, an empty list, or columns of unequal length."""
    body = _features(payloads, column)
    error = F.expr("""CASE WHEN NOT (__kind LIKE 'ARRAY%' OR __kind LIKE 'OBJECT%') THEN 'neither an object nor a list'
        WHEN __kind LIKE 'ARRAY%' AND size(try_variant_get(__v, '$', 'array<variant>')) = 0 THEN 'no window'
        WHEN __columnar AND size(array_distinct(__lengths)) > 1 THEN 'columns of unequal length' END""")
    return body.withColumn("error", error).where("error IS NOT NULL").select(*payloads.columns, "error")


def payload_rows(payloads: DataFrame, fields: list[str], column: str = "payload") -> DataFrame:
    """Request bodies to rows: a list of objects, an object of equally long lists, or one object, bare or under "features".

    Values are numbers or texts, as text; a nested value, a boolean or null makes the field missing, and so does an item
    that is no object. Bodies that payload_errors names give no row.
    """
    body = _features(payloads, column).where("size(coalesce(array_distinct(__lengths), array(0))) = 1")
    places = "transform(sequence(0, __lengths[0] - 1), i -> map_from_entries(transform(map_entries(__of), e -> struct(e.key, try_variant_get(e.value, '$', 'array<variant>')[i]))))"
    rows = F.expr(f"""CASE WHEN __kind LIKE 'ARRAY%' THEN transform(try_variant_get(__v, '$', 'array<variant>'), x -> coalesce(try_variant_get(x, '$', 'map<string, variant>'), map()))
        WHEN __columnar THEN CASE WHEN __lengths[0] > 0 THEN {places} ELSE array() END
        WHEN __kind LIKE 'OBJECT%' THEN array(__of) END""")
    out = body.select(*payloads.columns, F.posexplode(rows).alias("row", "__r"))

    def value(name: str):
        x = F.try_element_at("__r", F.lit(name))
        plain = F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)")
        return F.when(plain, F.try_variant_get(x, "$", "string")).alias(name)

    return out.select(*payloads.columns, "row", *map(value, fields))


#: Fixed ranges of a scenario's samples, both ends included, for normal traffic and floods of low, medium and high
#: intensity: whole numbers, but for same_srv_rate. Packets back and ACK flags of normal traffic lie around the packets.
RANGES = {
    "flow_duration_ms": ((8000, 60000), (2200, 5000), (1000, 2400), (450, 1200)),
    "total_fwd_packets": ((25, 130), (260, 520), (700, 1300), (1300, 2400)),
    "total_bwd_packets": (None, (60, 170), (30, 95), (8, 45)),
    "fwd_packet_length_max": ((300, 1200), (64, 180), (64, 180), (64, 180)),
    "bwd_packet_length_max": ((300, 1200), (48, 160), (48, 160), (48, 160)),
    "syn_flag_count": ((1, 12), (180, 420), (620, 1160), (1180, 2250)),
    "ack_flag_count": (None, (45, 140), (24, 85), (6, 38)),
    "rst_flag_count": ((0, 2), (0, 4), (0, 4), (0, 4)),
    "psh_flag_count": ((2, 20), (0, 6), (0, 6), (0, 6)),
    "unique_dst_ports": ((3, 16), (1, 2), (1, 2), (1, 2)),
    "same_srv_rate": ((0.20, 0.78), (0.82, 0.93), (0.90, 0.98), (0.96, 1.00)),
    "failed_login_attempts": ((0, 1), (0, 0), (0, 0), (0, 0)),
}
LEVELS = ("normal", "low", "medium", "high")


def synthetic_scenario(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n normal samples and n of each of three flood intensities; the same rows for a seed, at any partitioning.

    Lengths follow from packets and their largest length, at a mean of 45 to 75 % of it, and rates from sums and duration.
    """
    if n < 1:
        raise contracts.ContractError("a scenario needs a sample per group")
    level = F.col("level")
    share = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("i"), level), F.lit(1 << 30)) / float(1 << 30)
    whole = lambda k, low, high: F.floor(low + share(k) * (high - low + 1)).cast("double")
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), level + 1)
    name = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), level + 1)
    out = spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, range(4)))).alias("level"))
    around = {"total_bwd_packets": ("total_fwd_packets", 20, 35, 45), "ack_flag_count": ("total_bwd_packets", 10, 15, 20)}
    for k, (c, bounds) in enumerate(RANGES.items()):
        low, high = (pick([b[j] if b else 0 for b in bounds]) for j in (0, 1))
        if c in around:
            of, least, under, over = around[c]
            low = F.when(level == 0, F.greatest(F.lit(float(least)), F.col(of) - under)).otherwise(low)
            high = F.when(level == 0, F.col(of) + over).otherwise(high)
        out = out.withColumn(c, F.round(low + share(k) * (high - low), 2) if c == "same_srv_rate" else whole(k, low, high))
    for k, way in enumerate(("fwd", "bwd")):
        longest = F.col(f"{way}_packet_length_max")
        mean = F.round(longest * 0.45 + share(100 + k) * longest * 0.30, 2)
        out = out.withColumn(f"total_length_{way}_packets", F.floor(F.col(f"total_{way}_packets") * mean).cast("double"))
    seconds = F.col("flow_duration_ms") / 1000
    kind = name("Normal Traffic", *(f"SYN Flood - {x.title()} Intensity" for x in LEVELS[1:]))
    out = out.withColumns({
        "flow_bytes_s": F.round((F.col("total_length_fwd_packets") + F.col("total_length_bwd_packets")) / seconds, 2),
        "flow_packets_s": F.round((F.col("total_fwd_packets") + F.col("total_bwd_packets")) / seconds, 2),
        "sample_id": F.format_string("%s-%s", name("normal", *(f"syn-flood-{x}" for x in LEVELS[1:])), F.lpad(F.col("i").cast("string"), F.greatest(F.lit(3), F.length(F.col("i").cast("string"))), F.lit("0"))),
        "traffic_group": name("normal", *(f"syn_flood_{x}" for x in LEVELS[1:])),
        "expected_prediction": kind, "expected_severity": name("safe", "warning", "critical", "critical"),
        "Binary_Label": (level > 0).cast("int"), "Attack_Type": kind,
    })
    return out.select(*(f.name for f in SCENARIO))


def outside_scenario(samples: DataFrame) -> DataFrame:
    """Per traffic group of a synthetic scenario: rows, distinct ids, and rows that break a range or a derivation."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.regexp_replace("traffic_group", "^syn_flood_", "")).cast("int")
    good = F.lit(True)
    for c, bounds in RANGES.items():
        low, high = (F.element_at(F.array(*(F.lit(float(b[j])) if b else F.lit(None).cast("double") for b in bounds)), level) for j in (0, 1))
        good = good & F.coalesce((F.col(c) >= low) & (F.col(c) <= high), F.lit(True))
    fwd, bwd, ack, seconds = F.col("total_fwd_packets"), F.col("total_bwd_packets"), F.col("ack_flag_count"), F.col("flow_duration_ms") / 1000
    normal = (bwd >= F.greatest(F.lit(20), fwd - 35)) & (bwd <= fwd + 45) & (ack >= F.greatest(F.lit(10), bwd - 15)) & (ack <= bwd + 20)
    good = good & ((level > 1) | normal)
    for way in ("fwd", "bwd"):
        mean = F.col(f"total_length_{way}_packets") / F.col(f"total_{way}_packets") / F.col(f"{way}_packet_length_max")
        good = good & mean.between(0.40, 0.76)
    length = F.col("total_length_fwd_packets") + F.col("total_length_bwd_packets")
    good = good & (F.abs(F.col("flow_bytes_s") - length / seconds) < 0.01) & (F.abs(F.col("flow_packets_s") - (fwd + bwd) / seconds) < 0.01)
    return samples.groupBy("traffic_group").agg(F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_ids"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_outside"), F.min("expected_severity").alias("expected_severity"))


#: The window of an attack where all of these features are asked for (fixed); sport grows by 1 a step.
TEMPLATE = {
    "sport": 23357.0, "dsport": 80.0, "dur": 0.6921604882400858, "sbytes": -0.27913849646862504, "dbytes": 0.4902893473607708, "sttl": 31.0, "dttl": 254.0,
    "sloss": -0.2857142857142857, "dloss": 0.3333333333333333, "Sload": -1.17510058087282, "Dload": 0.04959044433092215, "Spkts": -0.08695652173913043,
    "Dpkts": 0.14285714285714285, "stcpb": 0.014064952612622406, "dtcpb": 0.019966255078546786, "smeansz": 0.06060606060606061, "dmeansz": 1.9545454545454546,
    "trans_depth": 1.0, "res_bdy_len": 9.394909401310617, "Sjit": 0.5466210800854902, "Djit": 14.077697718423678, "Stime": -0.015487268416648664,
    "Ltime": -0.015487261637967667, "Sintpkt": 1.9100044581417834, "Dintpkt": 0.9202447792102867, "tcprtt": 500.0, "synack": 10.606701940035274,
    "ackdat": 306.9726027397261, "ct_state_ttl": 1.0, "ct_flw_http_mthd": 1.0, "ct_srv_src": -0.16666666666666666, "ct_srv_dst": -0.4,
    "ct_dst_ltm": -0.3333333333333333, "ct_src_ltm": -0.6666666666666666, "proto_tcp": 1.0, "state_FIN": 1.0, "service_http": 1.0,
}
#: A scenario window's values (fixed): for an attack, for other traffic, whether an attack's grows with its
#: intensity, and whether the value grows along the window.
_WINDOW = {
    "proto_tcp": (1.0, 1.0, False, False), "state_REQ": (1.0, 0.0, False, False), "state_CON": (0.0, 1.0, False, False), "service_http": (1.0, 1.0, False, False),
    "dsport": (80.0, 80.0, False, False), "sbytes": (1200.0, 320.0, True, True), "dbytes": (24.0, 460.0, False, True), "Spkts": (180.0, 18.0, True, True),
    "Dpkts": (3.0, 20.0, False, True), "Sload": (900000.0, 1200.0, True, True), "Dload": (35.0, 1400.0, False, True), "sttl": (254.0, 31.0, False, False),
    "dttl": (0.0, 29.0, False, False), "smeansz": (64.0, 96.0, False, False), "dmeansz": (8.0, 110.0, False, False), "ct_srv_src": (40.0, 2.0, True, False),
    "ct_srv_dst": (40.0, 2.0, True, False), "ct_dst_src_ltm": (35.0, 2.0, True, False), "ct_src_dport_ltm": (35.0, 1.0, True, False), "ct_state_ttl": (6.0, 1.0, False, False),
    "Sintpkt": (0.2, 80.0, False, False), "Dintpkt": (0.0, 60.0, False, False), "tcprtt": (0.0, 0.02, False, False), "synack": (0.0, 0.01, False, False),
    "ackdat": (0.0, 0.01, False, False), "dloss": (0.0, 1.0, False, False),
}


def scenario_windows(events: DataFrame, width: int, features: list[str]) -> DataFrame:
    """Each event (prediction, confidence) as `width` rows of the features; those without a rule are 0.

    An attack is the template, if all of its features are asked for.
    """
    whole = all(f in features for f in TEMPLATE)
    p = F.lower("prediction")
    attack = p.contains("syn flood")
    power = F.when(p.contains("medium"), 1.5).when(p.contains("high"), 2.0).otherwise(1.0)
    each = events.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    along = (F.col("step") + 1) / F.lit(float(width))

    def value(name: str):
        if name == "sport":
            return F.lit(49152.0) + F.col("step")
        if name == "dur":
            return F.when(attack, F.greatest(F.lit(0.001), 0.04 / power)).otherwise(1.2)
        if name == "sloss":
            return F.when(attack, F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5)) * 8)).otherwise(0.0)
        if name not in _WINDOW:
            return F.lit(0.0)
        hit, calm, stronger, grows = _WINDOW[name]
        out = F.when(attack, hit * power if stronger else F.lit(hit)).otherwise(calm)
        return out * along if grows else out

    def shown(name: str):
        if not whole:
            return value(name)
        fixed = F.lit(TEMPLATE.get(name, 0.0)) + (F.col("step") if name == "sport" else 0.0)
        return F.when(attack, fixed).otherwise(value(name))

    return each.withColumns({f: shown(f) for f in features})
