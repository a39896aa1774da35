"""Part of cohortsmith."""
