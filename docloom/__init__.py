"""docloom: document analytics on Spark (DataFrame and SQL operators)."""
