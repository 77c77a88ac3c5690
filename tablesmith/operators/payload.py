"""JSON requests and responses of an image service, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col

# Status of a decoded response.
OK, BAD = "ok", "no valid data[0].b64_json"


def request_json(prompt: Column | str, model: Column | str, size: Column | str, quality: Column | str) -> Column:
    """The request body; empty optional values are left out."""
    optional = lambda c: F.nullif(col(c), F.lit(""))
    return F.to_json(F.struct(col(model).alias("model"), col(prompt).alias("prompt"), optional(size).alias("size"), optional(quality).alias("quality")))


def image_bytes(body: Column | str) -> Column:
    """The decoded first image of a response body; null when the body has none or its base64 is not strict."""
    return F.try_to_binary(F.get_json_object(col(body), "$.data[0].b64_json"), F.lit("base64"))


def image_status(body: Column | str) -> Column:
    return F.when(image_bytes(body).isNotNull(), OK).otherwise(BAD)
