"""quernlake: a PySpark-native engine for a retail sales warehouse and near-duplicate text detection."""
