"""loomtext: a PySpark-native engine for building, augmenting and auditing labelled text corpora."""
