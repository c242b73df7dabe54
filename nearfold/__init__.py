"""nearfold: nearest-neighbour risk scoring on Spark."""
