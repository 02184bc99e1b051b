"""Operators for large-scale training-data pipelines. Nothing else in tarn imports this package."""
