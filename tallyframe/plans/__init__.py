"""Query shapes shared by the operators: value counts with ranks, exact
quantiles, fused statistics, correlations, chart tables and whole-table jobs."""
