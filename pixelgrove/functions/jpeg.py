"""Image size from the header of JPEG bytes, without decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def size_of(data: bytes | None) -> tuple[int | None, int | None]:
    """(width, height) from the first baseline, extended or progressive frame header; nulls if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None, None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None, None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if 0xD0 <= marker <= 0xD8 or marker == 0x01:  # without a length
            at += 2
            continue
        if marker in (0xC0, 0xC1, 0xC2) and at + 9 <= len(data):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


def _sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(x) for x in content], columns=["width", "height"]).astype("Int32")


def jpeg_size(content: Column) -> Column:
    """Struct (width, height) of JPEG bytes."""
    return F.pandas_udf(_sizes, "width int, height int")(content)
