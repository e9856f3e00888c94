"""Order-independent identities of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(*values: Column) -> Column:
    """The digest of a row's values as text, each with its length before it, so no two rows of different values are spelt alike; null is not the empty text."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat_ws("|", *parts), 256)


#: Digests that one text is made of.
BUCKET_ROWS = 4096


def fingerprint(rows: DataFrame, *values: Column, places: int | None = None) -> DataFrame:
    """(fingerprint): the identity of a table as a multiset of rows, a tree of digests over the row digests' hexadecimal places.

    A bucket is the rows whose digests begin alike; the digest of a bucket is that of its sorted row digests, and the one of a level that of the
    sorted buckets below it, two places at a time, so no text has more than 256 of them. `places` of the first level: as many as
    keep BUCKET_ROWS rows in a bucket (equal rows are counted, not repeated), by the number of rows.
    """
    digests = rows.select(row_digest(*values).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    if places is None:
        count, places = digests.count(), 2
        while count > BUCKET_ROWS * 16**places:
            places += 2
    entry = F.concat_ws("*", "d", F.col("n").cast("string"))
    level = digests.groupBy(F.substring("d", 1, places).alias("b")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(entry))), 256).alias("d"))
    while places > 0:
        places = max(0, places - 2)
        joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat_ws(":", x["b"], x["d"])))
        level = level.groupBy(F.substring("b", 1, places).alias("b")).agg(F.sha2(joined, 256).alias("d"))
    return level.select(F.col("d").alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, order: list[str], *values: Column) -> DataFrame:
    """(fingerprint): the identity of the rows in the order of `order`, which must tell all rows apart: their places' values are part of each row."""
    return fingerprint(rows, F.lit("ordered"), *(F.col(c).cast("string") for c in order), *values)


def settings_digest(**settings) -> str:
    """The digest of settings, independent of their order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
