"""End-to-end plans and the named queries over the test tables."""
