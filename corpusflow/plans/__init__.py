"""Named queries over the test tables, each with SQL where SQL can say it."""
