"""voxloom: style and corpus analytics as Spark jobs."""
