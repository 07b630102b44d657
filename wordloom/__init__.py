"""wordloom: Spark-native data processing for a document-to-audio feed service."""
