"""Query plans over the test tables, with their SQL."""
