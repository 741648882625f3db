"""End-to-end plans and the catalogue of queries over the test tables."""
