"""Portrait geometry: which face, which crop rectangle, which output size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.operators import ordering

# Fixed values of the crop: output size, padding around a detected face, place of the head in the frame.
TARGET_W, TARGET_H = 800, 1000
RATIO = TARGET_W / TARGET_H
HAIR, SIDES, CHIN = 0.4, 0.25, 0.2
HEAD_FRACTION, HEAD_TOP = 0.7, 0.08
DETECT_MAX_SIDE = 1200


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def subject_faces(boxes: DataFrame, overrides: DataFrame) -> DataFrame:
    """One face per image: the n-th from the left when an override asks for it and it exists, else the largest.

    `boxes` is (image_id, pos, x, y, width, height, ...) with `pos` in detection order, `overrides` (image_id,
    subject). The largest face is an aggregate of one struct per image; the n-th from the left is cut out per part of an image's
    boxes first (`ordering.nth_per_key`), so no image has to fit one task.
    """
    box = F.struct(*[c for c in boxes.columns if c != "image_id"])
    largest = boxes.groupBy("image_id").agg(
        F.max_by(box, F.struct(F.col("width") * F.col("height"), -F.col("pos"))).alias("_largest")
    )
    asked = boxes.join(overrides, "image_id")
    chosen = ordering.nth_per_key(asked, "image_id", [F.col("x") + F.col("width") / 2, F.col("pos")], "subject").select("image_id", box.alias("_chosen"))
    return (
        largest.join(chosen, "image_id", "left")
        .withColumn("_face", F.coalesce("_chosen", "_largest"))
        .select("image_id", "_face.*", F.col("_chosen").isNotNull().alias("by_override"))
    )


def detection_scale(src_w: Column, src_h: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(float(DETECT_MAX_SIDE)) / F.greatest(src_w, src_h))


def detection_size(src_w: Column, src_h: Column) -> Column:
    scale = detection_scale(src_w, src_h)
    return F.struct(round_half_up(src_w * scale).alias("width"), round_half_up(src_h * scale).alias("height"))


def crop_rectangles(faces: DataFrame) -> DataFrame:
    """`faces` (src_w, src_h, x, y, width, height in detection pixels) with the crop and the output size.

    The padded head fills a fixed share of the frame; the frame keeps its ratio and stays inside the source;
    the output is never enlarged.
    """
    scale = detection_scale(F.col("src_w"), F.col("src_h"))
    at_source = faces.withColumns({f"_{c}": F.col(c) / scale for c in ("x", "y", "width", "height")})
    head_width = F.col("_width") * (1 + 2 * SIDES)
    wanted = at_source.withColumn("_crop_w", F.least(head_width / HEAD_FRACTION, F.col("src_w").cast("double")))
    capped = wanted.withColumn("_crop_h", F.least(F.col("_crop_w") / RATIO, F.col("src_h").cast("double")))
    too_high = F.col("_crop_w") / RATIO > F.col("src_h")
    sized = capped.withColumn(
        "crop_w", F.floor(F.when(too_high, F.col("_crop_h") * RATIO).otherwise(F.col("_crop_w")))
    ).withColumn("crop_h", F.floor("_crop_h"))
    centre = (
        (F.col("_x") - F.col("_width") * SIDES) + (F.col("_x") + F.col("_width") + F.col("_width") * SIDES)
    ) / 2
    head_top = F.col("_y") - F.col("_height") * HAIR
    left = round_half_up(centre - F.col("crop_w") / 2)
    top = round_half_up(head_top - F.col("crop_h") * HEAD_TOP)
    return (
        sized.withColumn("crop_left", F.greatest(F.lit(0), F.least(F.col("src_w") - F.col("crop_w"), left)))
        .withColumn("crop_top", F.greatest(F.lit(0), F.least(F.col("src_h") - F.col("crop_h"), top)))
        .withColumn("out_w", F.least(F.lit(TARGET_W), F.col("crop_w")))
        .withColumn("out_h", round_half_up(F.col("out_w") / RATIO))
        .drop("_x", "_y", "_width", "_height", "_crop_w", "_crop_h")
    )
