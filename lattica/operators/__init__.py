"""Traversals and algorithms over a :class:`lattica.graph.Graph`."""
