"""A Spark-native semantic analytics library: typed entities, relations, measures, features and loads as DataFrame plans."""
