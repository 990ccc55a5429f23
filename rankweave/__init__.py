"""rankweave: ordered-key analytics on Spark, with operators for training-data pipelines in rankweave.llm."""
