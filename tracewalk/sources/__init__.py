"""Where graphs, documents and logs come from and go to."""
