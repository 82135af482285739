"""DataFrame operators: joins, top-k, price aggregation, matching, reports."""
