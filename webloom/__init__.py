"""webloom: a Spark-native engine for searching, ranking and preparing web documents."""
