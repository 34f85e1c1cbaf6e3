"""DataFrame operators: spatial joins, statistics, graphs, routes, models and generators."""
