"""Training-data operators: scans, near-duplicate joins, mixing, sharding.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``queries.py`` binds them to the test tables.
"""
