"""foldloom: Spark jobs that align three-dimensional residue chains."""
