"""Page cursors: base64url of ``{"s": sort key, "id": row id}``, without padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURSOR = "struct<s:string,id:string>"


def encode_cursor(sort: Column, row_id: Column) -> Column:
    body = F.to_json(F.struct(sort.cast("string").alias("s"), row_id.alias("id")))
    encoded = F.base64(F.encode(body, "UTF-8"))
    # A long cursor would otherwise be wrapped into lines of 76 characters.
    encoded = F.regexp_replace(encoded, "[\r\n]", "")
    return F.rtrim(F.translate(encoded, "+/", "-_"), F.lit("="))


def decode_cursor(token: Column) -> Column:
    """The cursor's fields, or NULL for anything that is not a cursor."""
    plain = F.translate(token, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    body = F.try_to_binary(padded, F.lit("base64")).cast("string")
    fields = F.from_json(body, CURSOR)
    return F.when(fields["s"].isNotNull() & fields["id"].isNotNull(), fields)
