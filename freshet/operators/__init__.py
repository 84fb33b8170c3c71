"""DataFrame operators: joins, aggregates, windows, reductions and models."""
