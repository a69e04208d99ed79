"""Reports over several operators, and the catalogue of queries."""
