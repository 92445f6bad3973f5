"""DataFrame operators: skew-safe aggregation, attribution, ranking, grids, statistics, graphs."""
