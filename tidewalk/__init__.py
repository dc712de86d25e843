"""tidewalk: a Spark-native recommendation and text analytics library."""
