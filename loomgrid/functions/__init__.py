"""Column expressions: scalars, geometry and tags."""
