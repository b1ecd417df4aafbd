"""factlake: a PySpark-native engine for building and querying a verified fact corpus."""
