"""A PySpark-native engine that turns page-level documents into a source-grounded evidence table."""
