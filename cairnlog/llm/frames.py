"""Small helpers on frames that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores in front until no column has that name in any case."""
    used = {name.lower() for name in taken}
    while base.lower() in used:
        base = f"_{base}"
    return base


def squeezed(text: str) -> Column:
    """The text as compressed bytes: shuffles of it carry a third less."""

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return pd.Series(
            [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in texts],
            dtype=object,
        )

    return squeeze(text)


def unsqueezed(raw: bytes | None) -> bytes:
    import zstandard

    return b"" if raw is None else zstandard.ZstdDecompressor().decompress(raw)
