"""quillgraph: hybrid retrieval analytics and data-quality operators on PySpark DataFrames."""
