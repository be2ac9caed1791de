"""tessella: meshes, scenes and their encodings as Spark DataFrames."""
