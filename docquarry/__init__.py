"""A document analytics engine on Spark: declared plans in, Catalyst does the rest."""
