"""DataFrame-in, DataFrame-out operators, grouped by what they do."""
