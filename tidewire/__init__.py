"""tidewire: a PySpark-native analytics engine for news text."""
