"""Daily-bar strategy analytics as Spark jobs."""
