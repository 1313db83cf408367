"""Query catalogue: the operators wired to tables, and the SQL each is checked against."""
