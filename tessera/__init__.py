"""PySpark-native profiling, restructuring and compact encoding of semi-structured data."""
