"""cartolith: spatial-temporal analytics as plain PySpark DataFrame functions."""
