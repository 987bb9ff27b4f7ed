"""Cross-sectional panel analytics as native Spark DataFrame operators."""
