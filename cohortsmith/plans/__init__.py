"""Part of cohortsmith: requests, their rewrites and their compilation."""
