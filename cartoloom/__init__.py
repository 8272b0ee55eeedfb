"""cartoloom: DataFrame operators for search, link, review and visibility analytics on Spark."""
