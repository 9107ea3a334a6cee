"""A select-project-join engine on Spark: typed sources, predicates, equi-join plans, a strict SQL front end, checks."""
