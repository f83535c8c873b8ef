"""A PySpark-native engine for retrieval over a graph of events and entities."""
