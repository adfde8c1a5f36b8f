"""DataFrame operators: joins, aggregates, windows, sets, decisions and text jobs."""
