"""Where nodes, edges and references come from, and where they are kept."""
