"""A Spark-native engine that finds, explains, pseudonymises and restores personal data in text."""
