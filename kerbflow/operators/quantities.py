"""Material quantities, audit trail, step checks and agent logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.functions import geometry as G

#: Design facts of the recorded run.
DESIGN_FACTS = {
    "joal_2d_area": 1515.22, "inner_kerb_length": 231.5, "outer_kerb_length": 268.4, "slope_correction_factor": 1.003,
    "concrete_depth_m": 0.15, "concrete_width_m": 5.5, "gap65_depth_m": 0.15, "gap65_width_m": 6.0,
    "footpath_2d_area": 850.5, "footpath_depth_m": 0.15, "safety_factor_for_materials": 1.05,
}


def quantities(facts: DataFrame, slope_footpath: bool = True) -> DataFrame:
    """Areas, volumes and lengths from one row of design facts, one row a quantity."""
    c = F.col
    area = c("joal_2d_area") * c("slope_correction_factor")
    gap = area * c("gap65_width_m") / c("concrete_width_m")
    foot = c("footpath_2d_area") * (c("slope_correction_factor") if slope_footpath else F.lit(1.0))
    safe = c("safety_factor_for_materials")
    listed = [
        ("joal_3d_area", "m2", area), ("concrete_volume", "m3", area * c("concrete_depth_m") * safe), ("gap65_area", "m2", gap),
        ("gap65_volume", "m3", gap * c("gap65_depth_m") * safe), ("flush_nib_length", "m", c("outer_kerb_length") * c("slope_correction_factor")),
        ("subsoil_drain_length", "m", c("inner_kerb_length") * c("slope_correction_factor")), ("footpath_volume", "m3", foot * c("footpath_depth_m") * safe),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("quantity"), F.lit(u).alias("unit"), F.round(v, 4).alias("value")) for n, u, v in listed])
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def roll_up(features: DataFrame, facts: dict = DESIGN_FACTS) -> DataFrame:
    """Measured features (feature_type, area, length) to quantities with slope, depth and safety."""
    slope, safe = facts["slope_correction_factor"], facts["safety_factor_for_materials"]
    depth = F.when(F.col("feature_type") == "concrete", facts["concrete_depth_m"]).when(F.col("feature_type") == "gap65", facts["gap65_depth_m"]).when(F.col("feature_type") == "footpath", facts["footpath_depth_m"]).otherwise(0.0)
    return features.groupBy("feature_type").agg(
        F.round(F.sum(F.col("area") * slope), 4).alias("area_3d"), F.round(F.sum(F.col("area") * slope * depth * safe), 4).alias("volume"), F.round(F.sum(F.col("length") * slope), 4).alias("length_3d")
    )


def latest_audit(audit: DataFrame, order: list[str]) -> DataFrame:
    """One row a step: the last that arrived."""
    w = Window.partitionBy("step_id").orderBy(*[F.desc(c) for c in order])
    return audit.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def step_jumps(audit: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds whether each step follows the one before it by exactly one; the first of a key does."""
    before = F.lag("step_id").over(Window.partitionBy(key).orderBy(*order))
    return audit.withColumn("in_order", F.coalesce(F.col("step_id") - before == 1, F.lit(True)))


def log_rows(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) as log rows (conv_id, turn, agent, task, result).

    What tools return is shortened, what people and agents say is not.
    """
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    task = F.when(call, "prompt").when(result, "response").otherwise("tool")
    return messages.select("conv_id", "turn", F.col("role").alias("agent"), task.alias("task"), F.when(call | result, F.col("text")).otherwise(G.shortened(F.col("text"))).alias("result"))


def polygon_verdict(points: DataFrame, key: str, least_spread: float = 10.0) -> DataFrame:
    """Whether polygons have three points or more and a spread on both axes, in words."""
    by = points.groupBy(key).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"))
    verdict = F.when(F.col("n") < 3, "FAILED: fewer than three points").when((F.col("sx") < least_spread) | (F.col("sy") < least_spread), "FAILED: too small").otherwise("PASS")
    return by.select(key, F.col("n").alias("points"), verdict.alias("verdict"))


# The words in which a polygon is judged.
FEW_POINTS = "Critique: FAILED. A valid polygon must have at least 3 [y, x] ordered points."
TOO_SMALL = "Critique: FAILED. Area is far too small (Vert %.1f, Horiz %.1f). Found a speck instead of a stage."
SOUND = "Critique: PASS. Geometric spread is validated (Vert %.1f, Horiz %.1f). Proceed to human confirmation!"


def polygon_critique(points: DataFrame, key: str, least_spread: float = 10.0) -> DataFrame:
    """(key, critique): ``polygon_verdict`` in the words that agents expect."""
    by = points.groupBy(key).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).cast("double").alias("sx"), (F.max("y") - F.min("y")).cast("double").alias("sy"))
    told = [F.bround(c, 1) for c in ("sy", "sx")]  # halves to even, which the format does not do
    small = (F.col("sx") < least_spread) | (F.col("sy") < least_spread)
    return by.select(key, F.when(F.col("n") < 3, FEW_POINTS).when(small, F.format_string(TOO_SMALL, *told)).otherwise(F.format_string(SOUND, *told)).alias("critique"))


def normalised(points: DataFrame, width: float, height: float) -> DataFrame:
    """Coordinates on a grid of 1000 by 1000, two decimals, halves to even."""
    return points.withColumn("ny", F.bround(F.col("y") / height * 1000, 2)).withColumn("nx", F.bround(F.col("x") / width * 1000, 2))


def run_manifest(spark, inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """One row (inputs, outputs, written_at): what a run read and wrote, by name."""
    kind = "inputs map<string, string>, outputs map<string, string>"
    return spark.createDataFrame([(inputs, outputs)], kind).withColumn("written_at", F.current_timestamp())


#: The colours of the drawn lines as blue, green, red, and their thickness.
LINE_STYLES = {"inner": ((255, 0, 255), 1), "center": ((0, 191, 255), 1), "outer": ((255, 255, 0), 1)}


def visual_manifest(spark, overlay_mask: str, overlay_plan: str, transparent_layer: str) -> DataFrame:
    """One row that names the layers of a drawing and how their lines are drawn."""
    kind = "overlay_mask string, overlay_plan string, transparent_layer string, line_styles map<string, struct<color_bgr: array<int>, thickness: int>>"
    styles = {k: (list(c), t) for k, (c, t) in LINE_STYLES.items()}
    return spark.createDataFrame([(overlay_mask, overlay_plan, transparent_layer, styles)], kind)


def forward_slashed(df: DataFrame) -> DataFrame:
    """The table with forward slashes in all strings, also those in arrays, structs and maps."""
    from pyspark.sql import types as T

    def mend(c, kind):
        if isinstance(kind, T.StringType):
            return F.translate(c, "\\", "/")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: mend(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: mend(v, kind.valueType))
        if isinstance(kind, T.StructType):
            made = F.struct(*[mend(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(c.isNotNull(), made)
        return c

    return df.select([mend(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
