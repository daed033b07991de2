"""DataFrame operators: filters, aggregates, cross-tabs, comments, scoring, topics."""
