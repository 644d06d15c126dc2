"""Code-graph analytics on Spark: source lakes in, nodes, edges and profiles out."""
