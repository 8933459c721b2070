"""Photo-quality analytics as Spark plans: scanning, metrics, grouping and review of large photo collections."""
