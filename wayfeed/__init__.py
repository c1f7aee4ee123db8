"""wayfeed: vehicle-feed analytics as plain PySpark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; "now" is always the
parameter ``as_of``.  All instants are UTC, so the session time zone must be
UTC (see :func:`wayfeed.functions.clock.use_utc`).
"""
