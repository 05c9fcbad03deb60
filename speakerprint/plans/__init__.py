"""Named queries over the supplied tables, each with SQL that states the expected result."""
