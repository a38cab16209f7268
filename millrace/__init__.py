"""An analytics engine on PySpark: SQL, datasets, OLAP cubes, logs and mergeable state."""
