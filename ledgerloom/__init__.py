"""ledgerloom: a PySpark-native engine for document-derived financial records."""
