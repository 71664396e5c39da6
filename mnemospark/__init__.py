"""mnemospark: a PySpark-native analytics engine for long-term text memory."""
