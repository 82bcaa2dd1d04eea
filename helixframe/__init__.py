"""helixframe: sequence-collection analytics and corpus operators on PySpark DataFrames."""
