"""askalot: survey microdata into evaluation datasets, as Spark DataFrame operators."""
