"""DataFrame operators: filters, joins, aggregations and the novelty join."""
