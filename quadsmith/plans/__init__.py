"""SPARQL text to algebra, algebra to better algebra, algebra to DataFrames."""
