"""The data set catalog as a small DataFrame.

Fixed values of the reference (15 data sets): code, name, fault types,
sampling rate (Hz), duration (s), channels, design target, property, features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values (reference catalog), in the reference's order
CATALOG = [
    ("01", "Paderborn", ["normal", "inner_race", "outer_race", "cage"], 64000, 4, 3, "Fault diagnosis", "Multiple sensors"),
    ("02", "CWRU", ["normal", "inner_race", "outer_race", "ball"], 12000, 10, 1, "Fault diagnosis", "Vibration"),
    ("03", "XJTU-SY", ["normal", "inner_race", "outer_race", "cage"], 25600, 8, 1, "RUL prediction & Fault diagnosis", "Vibration"),
    ("04", "IMS", ["normal", "failure"], 20480, 24, 1, "RUL prediction", "Vibration"),
    ("05", "FEMTO", ["normal", "failure"], 25600, 6, 2, "RUL prediction", "Multiple sensors"),
    ("06", "MFPT", ["normal", "inner_race", "outer_race", "ball"], 97600, 2, 1, "Fault diagnosis", "Vibration"),
    ("07", "HUST Bearing", ["inner_crack", "outer_crack", "ball_crack", "inner_outer_combination", "inner_ball_combination", "outer_ball_combination"], 51200, 10, 1, "Fault diagnosis", "Vibration"),
    ("09", "Electric Motor", ["normal", "bearing", "rotor", "stator"], 42000, 5, 4, "Fault diagnosis", "Multiple sensors"),
    ("12", "Rotor Broken Bar", ["normal", "broken_bar"], 50000, 3, 1, "Fault diagnosis", "Current"),
    ("13", "WT Planetary Gearbox", ["normal", "sun_gear", "planet_gear", "ring_gear"], 48000, 6, 1, "Fault diagnosis", "Vibration"),
    ("16", "CQU Gearbox", ["normal", "gear_wear", "gear_break", "bearing"], 20000, 8, 3, "Fault diagnosis", "Multiple sensors"),
    ("17", "UConn Gearbox", ["normal", "gear_wear", "gear_break"], 20000, 4, 1, "Fault diagnosis", "Vibration"),
    ("18", "MAFAULDA", ["normal", "bearing", "rotor", "stator", "gear"], 51200, 12, 4, "Fault diagnosis", "Multiple sensors"),
    ("19", "Mendeley Bearing", ["normal", "inner_race", "outer_race", "ball"], 9600, 3, 1, "Fault diagnosis", "Vibration"),
    ("14", "Microsoft Azure", ["normal", "failure"], 1, 365, 4, "RUL prediction", "Telemetry, Logs"),
]

# fixed values: the measured features of each data set
FEATURES = {
    "01": ["vibration", "current", "temperature", "speed", "torque", "radial_load"],
    "02": ["vibration"],
    "03": ["vibration"],
    "04": ["vibration"],
    "05": ["vibration", "temperature"],
    "06": ["vibration"],
    "07": ["vibration"],
    "09": ["current", "vibration", "temperature", "speed"],
    "12": ["current"],
    "13": ["vibration"],
    "16": ["vibration", "temperature", "speed"],
    "17": ["vibration"],
    "18": ["vibration", "current", "temperature", "speed"],
    "19": ["vibration"],
    "14": ["telemetry", "errors", "maintenance", "machines"],
}

SCHEMA = ("code string, name string, fault_types array<string>, sampling_rate int, duration int, "
          "channels int, design_target string, property string, features array<string>")


def catalog(spark: SparkSession) -> DataFrame:
    """One row per data set; ``description`` is put together from its other columns."""
    rows = spark.createDataFrame([(*r, FEATURES[r[0]]) for r in CATALOG], SCHEMA)
    return rows.withColumn("description", F.format_string(
        "%s: %s from %s, %d channel(s) at %d Hz", "name", F.lower("design_target"), F.array_join("features", ", "), "channels", "sampling_rate"))


def dataset_code(raw: Column) -> Column:
    """Code parsed from a file name, left-padded to 2 digits."""
    return F.lpad(raw, 2, "0")


def tag_with_catalog(df: DataFrame, code_col: str = "dataset_code") -> DataFrame:
    """Left join of catalog names onto rows by code; unknown codes become
    'Unknown (xx)'.  The catalog has a fixed 15 rows, so it is broadcast."""
    cat = F.broadcast(catalog(df.sparkSession).select(F.col("code").alias(code_col),
                                                      F.col("name").alias("_name")))
    return (df.join(cat, code_col, "left")
            .withColumn("dataset_name", F.coalesce(F.col("_name"),
                                                   F.concat(F.lit("Unknown ("), F.col(code_col), F.lit(")"))))
            .drop("_name"))
