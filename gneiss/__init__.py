"""gneiss: a PySpark-native engine for molecular descriptors, model search and corpus preparation."""
