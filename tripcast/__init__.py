"""Trip-demand analytics as Spark DataFrame operators."""
