"""A PySpark-native analytics engine for columnar, numeric and market-style data."""
