"""folio: a PySpark-native engine that turns tables of web pages into compact, auditable content tables."""
