"""Column functions: names and keys, paths, arrays, tagged JSON, encryption."""
