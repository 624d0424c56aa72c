"""A PySpark-native analytics engine for archives of text, code, pages and vectors."""
