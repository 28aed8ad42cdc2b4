"""mediasift: a Spark-native engine for moderating media collections and preparing text corpora."""
