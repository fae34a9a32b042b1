"""A PySpark-native analytics engine over page-description documents."""
