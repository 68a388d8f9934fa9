"""weft: a labelled-property-graph and data-processing engine on PySpark DataFrames."""
