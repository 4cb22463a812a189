"""Engineering-drawing take-off and corpus analytics as Spark DataFrame operators."""
