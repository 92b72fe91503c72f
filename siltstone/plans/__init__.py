"""Named queries over a directory of tables, and their SQL oracles."""
