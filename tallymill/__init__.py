"""A PySpark-native analytics engine for financial line items."""
