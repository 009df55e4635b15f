"""trialweave: a PySpark-native engine for clinical-study tables."""
