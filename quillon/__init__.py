"""A PySpark-native engine for symbolic relational expressions."""
