"""Ready-made queries over the test tables and the mapping that feeds them."""
