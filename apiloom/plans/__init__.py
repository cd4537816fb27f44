"""From facts to nodes and edges."""
