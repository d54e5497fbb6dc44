"""The operators: elements, links, scores, catalog, ranking."""
