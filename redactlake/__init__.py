"""redactlake: a PySpark-native engine for privacy redaction of timed media and text."""
