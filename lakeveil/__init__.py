"""A Spark-native engine for finding, scoring and governing personal data."""
