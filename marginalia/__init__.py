"""A PySpark engine for ranked retrieval, graphs and event logs over document collections."""
