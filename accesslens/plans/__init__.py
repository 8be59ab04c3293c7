"""Scale-aware plan helpers: segments, ranks, quantiles, lookups."""
