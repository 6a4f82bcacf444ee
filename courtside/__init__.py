"""courtside: point-in-time analytics for dated head-to-head results, on Spark."""
