"""SQL over a store: views, and a table function for scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .store import Store


def query(store: Store, text: str) -> DataFrame:
    """Runs SQL with the views changelog, current and manifest of the store, and the function scan(start, end)."""
    store.register_views()
    register_scan(store)
    return store.spark.sql(text)


def register_scan(store: Store, name: str = "scan") -> None:
    """`SELECT * FROM scan('a', 'z')` gives the live pairs of [start, end), as of the last register_views().

    It is a SQL function over the view `current`, so its range goes to the files as that of a filter does.
    """
    kind = "BINARY" if store.options.binary else "STRING"
    store.spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(low {kind}, high {kind}) RETURNS TABLE(key {kind}, value {kind}) "
        "RETURN SELECT c.key, c.value FROM current c WHERE c.key >= low AND c.key < high"
    )
