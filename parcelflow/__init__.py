"""parcelflow: a Spark-native engine for territorial lineage and area accounting."""
