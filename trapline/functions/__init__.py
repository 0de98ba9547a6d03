"""Column expressions: probabilities, densities, projection, reproducible uniforms."""
