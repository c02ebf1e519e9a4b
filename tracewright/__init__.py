"""Multi-source provenance reconstruction and near-duplicate attribution on Spark."""
