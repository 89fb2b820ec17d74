"""docloom: a Spark-native engine for document corpora, retrieval and evaluation."""
