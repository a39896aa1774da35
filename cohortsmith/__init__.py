"""Cohort queries on Spark: a tree of criteria over patient-centred tables becomes one lazy DataFrame."""
