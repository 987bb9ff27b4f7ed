"""Digests of whole tables, whatever the order of their rows."""

from pyspark.sql import functions as F


def digest_parts(columns):
    """Order-insensitive digest of rows as aggregates that another engine can repeat: the count, and the two 64-bit halves
    of the MD5 of each row's text (NULL as \\N, fields joined by |), summed."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    half = lambda at: F.sum(F.conv(F.substring(F.md5(text.cast("binary")), at, 16), 16, 10).cast("decimal(28,0)"))
    return {"n_rows": F.count(F.lit(1)), "high": half(1), "low": half(17)}


def digest_text(n, high, low):
    """SHA-256 of the count and both sums modulo 2^64."""
    whole = F.lit(str(2 ** 64)).cast("decimal(38,0)")
    part = lambda c: F.pmod(F.coalesce(c, F.lit(0)).cast("decimal(38,0)"), whole).cast("decimal(20,0)").cast("string")
    return F.sha2(F.concat_ws("|", n.cast("string"), part(high), part(low)), 256)
