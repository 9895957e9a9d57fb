"""The driver's tables seen as spatial datasets, and the queries registered over them."""
