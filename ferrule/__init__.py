"""A Spark-native engine for the analytical SQL of a hybrid transactional/analytical store."""
