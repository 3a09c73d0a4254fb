"""Graph-pattern analytics on Spark: quads, SPARQL, search, validation and convergent merging."""
