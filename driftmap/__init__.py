"""Change-history and code-structure analytics as Spark DataFrame plans."""
