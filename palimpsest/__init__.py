"""palimpsest: a PySpark-native engine for conversation memory and training-corpus preparation."""
