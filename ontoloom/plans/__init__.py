"""Named queries: the operators applied to the project's tables, with their SQL twins."""
