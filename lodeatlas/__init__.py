"""lodeatlas: a PySpark-native engine for catalogs of AI models and the data around them."""
