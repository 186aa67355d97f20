"""quarterline: panel-forecast analytics expressed with the Spark DataFrame API."""
