"""Column-level building blocks: rectangles, paths, distances, cells, geometry."""
