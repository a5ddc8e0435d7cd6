"""Plans: search drivers, experiment runs, reports, and the query catalog."""
