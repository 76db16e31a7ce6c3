"""archlens: media-archive analytics as Spark DataFrame operators."""
