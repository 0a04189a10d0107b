"""codelake: code-intelligence analytics as Spark jobs over plain tables."""
