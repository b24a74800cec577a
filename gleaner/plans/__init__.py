"""End-to-end jobs over the operators, and the registered queries with their reference SQL."""
