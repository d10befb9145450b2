"""statemill: statement analytics expressed as Spark DataFrame operators."""
