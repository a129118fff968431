"""PySpark-native panel analytics: every operator is a ``DataFrame -> DataFrame`` function."""
