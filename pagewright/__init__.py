"""pagewright: technical manuals to searchable, citable evidence as Spark jobs."""
