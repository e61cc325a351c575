"""Evidence fusion, similarity matching and graph inference as Spark DataFrame transforms."""
