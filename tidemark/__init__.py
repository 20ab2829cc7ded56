"""Bar analytics and strategy evaluation on Spark."""
