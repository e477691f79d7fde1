"""Plan shapes shared by the operators: skew-safe picks, ordered totals, hash strata, one-scan summaries."""
