"""No streaming operators: requests are evaluated over whole tables, and cohorts change by stored differences (see store)."""
