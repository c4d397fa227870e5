"""A PySpark-native engine for analysing and searching source-code repositories."""
