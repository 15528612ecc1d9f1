"""Named queries over the test tables, each with the SQL it is held against where SQL can express it."""
