"""Patient-to-trial matching analytics as Spark dataflow."""
