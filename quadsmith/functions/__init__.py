"""Terms and expressions as Spark columns."""
