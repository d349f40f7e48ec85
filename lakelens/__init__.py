"""lakelens: table profiling, association, modelling and scoring on Spark DataFrames."""
