"""A PySpark-native analytics engine: typed query plans over a catalog of tables, compiled to DataFrames."""
