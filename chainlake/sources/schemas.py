"""Schemas of the landing files and Bronze tables.

Numeric CSV fields are read as DOUBLE and cast afterwards: the collector
sometimes writes integers as ``12.0``, which an integer CSV schema turns into
NULL.  ``inTheMoney`` is read as text and normalised (``True``/``1.0``...).
"""

from pyspark.sql import types as T

D, S, L, B = T.DoubleType(), T.StringType(), T.LongType(), T.BooleanType()
TS, DT = T.TimestampNTZType(), T.DateType()


def _struct(fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRICE_CSV = _struct([
    ("Date", DT), ("Open", D), ("High", D), ("Low", D), ("Close", D), ("Volume", D),
    ("HV_20", D), ("HV_252", D), ("snapshot_time", TS), ("snapshot_str", S), ("ticker", S),
])

OPTIONS_CSV = _struct([
    ("contractSymbol", S), ("expiry", DT), ("option_type", S), ("strike", D), ("bid", D),
    ("ask", D), ("lastPrice", D), ("volume", D), ("openInterest", D),
    ("impliedVolatility", D), ("delta", D), ("gamma", D), ("theta", D), ("vega", D),
    ("inTheMoney", S), ("snapshot_time", TS), ("snapshot_str", S), ("ticker", S),
])

BRONZE_PRICE = _struct([
    ("Date", DT), ("Open", D), ("High", D), ("Low", D), ("Close", D), ("Volume", L),
    ("HV_20", D), ("HV_252", D), ("snapshot_time", TS), ("snapshot_str", S), ("ticker", S),
    ("_source_file", S),
])

BRONZE_OPTIONS = _struct([
    ("contractSymbol", S), ("expiry", DT), ("option_type", S), ("strike", D), ("bid", D),
    ("ask", D), ("lastPrice", D), ("volume", L), ("openInterest", L),
    ("impliedVolatility", D), ("delta", D), ("gamma", D), ("theta", D), ("vega", D),
    ("inTheMoney", B), ("snapshot_time", TS), ("snapshot_str", S), ("ticker", S),
    ("_source_file", S),
])

OVERRIDES = _struct([
    ("symbol", S), ("date", DT), ("high", D), ("low", D), ("updated_at", TS),
])

# The 18 option columns the collector keeps, in order.
OPTION_KEEP = [f.name for f in OPTIONS_CSV.fields]

# Columns that a landing file must have; others it may lack (NULL).
REQUIRED = {
    "price": ("Date", "Close", "snapshot_time", "snapshot_str", "ticker"),
    "options": ("contractSymbol", "expiry", "option_type", "strike", "snapshot_time", "snapshot_str", "ticker"),
}

# Rows that a landing file held but Bronze could not take as they were.
QUARANTINE = _struct([
    ("_source_file", S), ("reasons", T.ArrayType(S)), ("loaded", B), ("line", S),
])

# One row per file read, also of files without rows.
MANIFEST = _struct([
    ("path", S), ("length", L), ("modified", T.TimestampType()), ("n_rows", L), ("n_bad", L),
])
