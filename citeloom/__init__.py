"""citeloom: citation analytics as Spark DataFrame transformations."""
