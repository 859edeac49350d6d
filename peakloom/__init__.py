"""peakloom: Spark-native analytics for mass-composition problems."""
