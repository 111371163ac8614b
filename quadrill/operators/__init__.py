"""Search, grid index, quantiser, graph and maintenance."""
