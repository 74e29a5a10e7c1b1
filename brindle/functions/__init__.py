"""Row-level building blocks: values, scalar functions, expressions, reducers, text analysis, geography, geometry."""
