"""Index definitions, the query language and the command surface."""
