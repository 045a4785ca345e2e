"""A property-graph analytics engine on PySpark: graph queries, ETL operators, rules and algorithms over DataFrames."""
