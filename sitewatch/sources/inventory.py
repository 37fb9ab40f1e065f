"""Camera inventories: lists of objects whose field names drift, and the cameras wanted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import folded

ENVELOPE = "CCTVInventoryRequest"
#: Field names met for the same thing, the documented one first.
NAMES = {
    "id": ("device-id", "deviceId", "device_id", "id"),
    "name": ("device-name", "deviceName", "device_name", "name"),
    "description": ("cctv-other", "cctvOther", "description", "title"),
    "url": ("cctv-url", "cctvUrl", "cctv_url", "url", "imageUrl"),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "lon", "lng"),
}


def first_present(item: str, names: tuple[str, ...]) -> Column:
    """The first of the fields that is there and not empty."""
    return F.coalesce(*[F.nullif(F.col(item)[n], F.lit("")) for n in names])


def items(payloads: DataFrame) -> DataFrame:
    """(payload, place, item) of each object in payloads (payload, value): a list below the envelope key,
    or a bare one; what isn't an object is left out."""
    found = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", f"$.{ENVELOPE}"))
    rows = payloads.select("payload", F.posexplode(F.from_json(found, "array<string>")).alias("place", "raw")).where(F.ltrim("raw").startswith("{"))
    rows = rows.withColumn("item", F.from_json("raw", "map<string,string>"))
    return rows.select("payload", "place", *[first_present("item", v).alias(k) for k, v in NAMES.items()])


def described(items: DataFrame) -> DataFrame:
    """A line for people for each item."""
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("%.5f,%.5f", F.col("lat").try_cast("double"), F.col("lon").try_cast("double"))).otherwise("?")
    line = F.format_string("%6s  %-38s %20s  %s", F.coalesce("id", F.lit("None")), F.coalesce("name", F.lit("?")), place, F.coalesce("description", F.lit("")))
    return items.select("payload", "place", line.alias("line"))


def resolved(items: DataFrame, targets: DataFrame, blind: tuple[str, ...] = (), prefix: str = "cam-") -> DataFrame:
    """targets (name, crossing_id) with the first item whose name or description is the same but for case,
    spaces and punctuation, as a roster row; `found` is false where there is none."""
    keys = items.select("*", F.explode(F.filter(F.array(folded("name"), folded("description")), lambda x: x.isNotNull())).alias("_f"))
    first = Window.partitionBy("_f").orderBy("payload", "place")
    one = keys.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumnRenamed("name", "_name")
    rows = targets.withColumn("_t", folded("name")).join(one.drop("_name"), F.col("_t") == F.col("_f"), "left")
    scores = ~F.col("_t").isin(["".join(c for c in n.lower() if c.isalnum()) for n in blind]) if blind else F.lit(True)
    return rows.select(
        "name", "crossing_id", F.col("_f").isNotNull().alias("found"), F.concat(F.lit(prefix), "id").alias("camera_id"), F.regexp_replace("url", "^http://", "https://").alias("image_url"),
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), scores.alias("scores"))
