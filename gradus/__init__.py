"""Evidence, rating and recruitment analytics as Spark plans."""
